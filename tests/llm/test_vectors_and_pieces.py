"""Hard negatives, piece encoding and whitening against plain versions, with every odd case."""

import collections
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import hard_negatives, pieces, whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, anchor string, w string"


def vectors(rows, dims=6, seed=3):
    """Random rows, a third of them copies of one vector, near ties, and every odd case."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        v = rng.normal(0, 0.4, dims) if i % 3 else np.full(dims, 0.5)
        out.append((i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4)), "x", "a", "w"))
    odd = [None, [None] * dims, [float("nan")] * dims, [float("inf")] * dims]
    out += [(rows + k, v, 1, "x", "a", "w") for k, v in enumerate(odd)] + [(300, [0.1] * dims, None, "x", "a", "w"), (None, [0.6] * dims, 2, None, None, None)]
    return out + [out[0], out[100 % rows]]


def plain_negatives(rows, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by sorting all rows; rows of (id, label, vector)."""
    last = 2**63 - 1
    rows = sorted(rows, key=lambda r: last if r[0] is None else r[0])
    found = []
    for a, (anchor, label, v) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = sorted((-int(np.dot(v, u)), last if i is None else i, k) for k, (i, _, u) in enumerate(rows))
        liked = [(-s, k) for s, _, k in scored if rows[k][1] == label and k != a][:positives]
        for good, p in liked:
            hard = [(-s, k) for s, _, k in scored if rows[k][1] != label and 30 * good <= -100 * s <= 90 * good]
            found += [(anchor, rows[p][0], rank + 1, rows[k][0], good, s) for rank, (s, k) in enumerate(hard[:negatives])]
    return found


@pytest.mark.parametrize("rows", [350, 1])
def test_hard_negatives(spark, monkeypatch, rows):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)  # several blocks of a label
    made = vectors(rows)
    df = spark.createDataFrame(made, VECTORS).repartition(3)
    step = lambda c: F.floor(c.cast("double") * 256).cast("long")
    sound = df.where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    asked = sound.select("vec_id", "label", F.transform("embedding", step).alias("steps"), (F.col("vec_id") % 100 == 0).alias("is_anchor"), "x", "anchor", F.lit(1).alias("rid"), F.lit(2).alias("id"), F.lit(0).alias("cell"))
    got = [tuple(r) for r in hard_negatives.hard_negatives(asked, vector_col="steps", anchor_col="is_anchor").collect()]
    kept = [(i, label, np.floor(256 * np.array(v)).astype(int)) for i, v, label, *_ in made if label is not None and v is not None and v[0] is not None and np.isfinite(v).all()]
    want = plain_negatives(kept)
    # of rows with one id, any may stand first: ids and scores are what counts
    assert collections.Counter(got) == collections.Counter(want) and (rows == 1 or len(want) > 50)
    assert hard_negatives.hard_negatives(asked.where("false"), vector_col="steps", anchor_col="is_anchor").count() == 0
    assert hard_negatives.hard_negatives(asked.withColumn("is_anchor", F.lit(None).cast("boolean")), vector_col="steps", anchor_col="is_anchor").count() == 0


def test_hard_negatives_of_large_entries_and_short_vectors(spark):
    big = 2**29
    rows = [(0, 1, [big, big], True), (1, 1, [big, big - 1], False), (2, 2, [big // 2, big // 2 + 1], False), (3, 2, [big // 2], False), (4, 2, [2**62, 2**62], False), (5, 2, [], False)]
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<long>, anchor boolean")
    got = [tuple(r) for r in hard_negatives.hard_negatives(df).collect()]
    good = big * (2 * big - 1)
    assert good > 2**53 and got == [(0, 1, 1, 2, good, big * (big + 1))]


def test_trees_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 300, (40, 16))
    some = np.round(np.concatenate([c + rng.normal(0, 4, (100, 16)) for c in centres]))
    rng.shuffle(some)
    asking, own = hard_negatives.Tree(some[::3], hard_negatives.ANCHOR_LEAF), hard_negatives.Tree(some, hard_negatives.LEAF)
    n, ids = len(asking.points), np.arange(len(some))
    low, cap = np.full((n, 1), hard_negatives.NONE + 1), np.full((n, 1), hard_negatives.LAST)
    asked = hard_negatives.Questions(np.arange(-n, 0), np.zeros(n, dtype=np.int64), low, cap, 5, True)
    scored = []
    offer = asked.offer
    asked.offer = lambda a, b, scores, *rest: scored.append(scores.size) or offer(a, b, scores, *rest)
    hard_negatives.search(asking, asked, own, 0, ids, ids)
    exact = (asking.points @ own.points.T).astype(np.int64)
    for k, row in enumerate(exact):
        order = np.lexsort((ids, -row))[:5]
        assert asked.id[k, 0].tolist() == order.tolist() and asked.score[k, 0].tolist() == row[order].tolist()
    assert sum(scored) < exact.size / 2


ODD = ["", " ", "  a  b ", "▁x ▁ y", "日本語 テキスト", "a\x00b", "é😀\n\n\tz", "ﬁ①Ａ ｶﾞ", "<s>hi</s><unk>", "x" * 300, " " * 77 + "e", "́a", "½ ² ﷺ", "a　b​"]


def odd_texts(count=400):
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab e▁ \t\né日😀ﬁ①Ａｶﾞ́ 12<s>​　½²ﷺ") for _ in range(rng.randrange(40))) for _ in range(count)]


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def variant(tmp_path, rule, trims, prefix, plain_kinds):
    """The public model under another normaliser of the library, with or without byte pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path(), "rb") as file:
        model.ParseFromString(file.read())
    if rule:
        own = sentencepiece_model_pb2.ModelProto()
        own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = trims, prefix
    if not plain_kinds:
        model.trainer_spec.byte_fallback = False
        model.pieces[500].type, model.pieces[1000].type = pieces.UNUSED, pieces.USER
        for k in range(3, 259):
            model.pieces[k].type = pieces.NORMAL
    path = tmp_path / "some.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize(("rule", "trims", "prefix", "plain_kinds"), [(None, False, True, True), ("nmt_nfkc", True, True, True), ("nfkc_cf", False, False, True), ("nmt_nfkc", True, False, False), ("nfkc_cf", True, True, False)])
def test_pieces_and_spans_equal_the_library(tmp_path, rule, trims, prefix, plain_kinds):
    import sentencepiece

    path = variant(tmp_path, rule, trims, prefix, plain_kinds)
    own, library = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert own.plain == (rule is None and plain_kinds)
    texts = odd_texts()
    for text, fast in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(text, return_type="proto").pieces
        for got in (own.encode(text), fast):
            assert got.ids.tolist() == [p.id for p in want]
            assert list(zip(got.begins.tolist(), got.ends.tolist(), strict=True)) == [(p.begin, p.end) for p in want]


def test_longest_prefix_wins(tmp_path):
    own = pieces.PieceModel(variant(tmp_path, "nfkc_cf", False, False, True))
    for text in ("ﬃ", "Å", "ｶﾞ", "㍿", "é"):
        made, origin = own.normalise(text.encode())
        assert made.decode() == unicodedata.normalize("NFKC", text).casefold()
        assert origin[-1] == len(text.encode()) and (np.diff(origin) >= 0).all()


def test_piece_encode(spark):
    import sentencepiece

    rows = [(i, t, "c") for i, t in enumerate([*odd_texts(60), None, "word " * 30_000, "tie", "tie"])] + [(None, "no id", "c"), (3, "▁x ▁ y", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = pieces.piece_encode(df, model_path()).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = collections.Counter((i, tuple(ids := library.encode(t or "", add_bos=True, add_eos=True)), library.decode(ids)) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    texts = dict((i, t or "") for i, t, _ in rows)
    for r in got:
        source = texts[r.doc_id].encode()
        assert r.n_tokens == len(r.ids) == len(r.begins) and b"".join(source[a:b] for a, b in zip(r.begins, r.stops, strict=True)) == source
    digested = pieces.piece_encode(df, model_path(), digests=True)
    assert digested.columns == ["doc_id", "n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"] and digested.count() == len(rows)
    assert pieces.piece_encode(df.where("false"), model_path()).count() == 0


def plain_whitening(rows):
    """Whitening in numpy of (id, vector) rows that take part."""
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    off = x - total / n
    values, axes = np.linalg.eigh(off.T @ off / n)
    order = np.argsort(-values)[:8]
    return n, ((n * x - total) ** 2).sum(axis=1), off @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whiten(spark):
    made = vectors(200, dims=12)
    df = spark.createDataFrame([*made, (7, [0.5], 1, "x", "a", "w"), (8, [], 1, "x", "a", "w")], VECTORS).repartition(3)
    got = whitening.whiten(df).toPandas()
    kept = [(i, v) for i, v, *_ in made if v is not None and v[0] is not None and np.isfinite(v).all()]
    n, deviation, white, explained = plain_whitening(kept)
    assert len(got) == 8 * n and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    key = lambda i, d: (-1 if i is None or i != i else i, d)
    assert sorted(map(key, got["vec_id"], got["deviation"])) == sorted(key(i, d) for (i, _), d in zip(kept, deviation, strict=True) for _ in range(8))
    unique = {i for i, c in collections.Counter(i for i, _ in kept).items() if c == 1 and i is not None}
    wide = got[got["vec_id"].isin(unique)].pivot(index="vec_id", columns="component", values="whitened")
    ours = np.array([wide.loc[i].to_numpy() for i, _ in kept if i in unique])
    plain = np.array([w for (i, _), w in zip(kept, white, strict=True) if i in unique])
    assert np.allclose(ours * np.sign((ours * plain).sum(axis=0)), plain, atol=1e-8)
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert whitening.whiten(df.where("false")).count() == 0 and whitening.whiten(df.where("embedding is null")).count() == 0


def test_whiten_without_spread(spark):
    rows = [(i, [0.25, -0.5, 1.0], 0, None, None, None) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 15 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in got)
    flat = [(i, [float(i % 7), 0.0, 1.0], 0, None, None, None) for i in range(70)]
    got = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)} and got[0].identity_error < 1e-12


def test_covariance_keeps_what_doubles_lose():
    from fractions import Fraction

    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (9000, 3)) + np.array([2**40, 10**9, -(2**39)])
    x[:, 2] += x[:, 0] - 2**40  # two dimensions that nearly agree
    n, sums = len(x), [int(s) for s in x.sum(axis=0).tolist()]
    high, low = whitening.outer_products(*whitening.centred(x, n, sums))
    off = [[n * int(v) - s for v, s in zip(row, sums, strict=True)] for row in x.tolist()]
    for i in range(3):
        for j in range(3):
            exact = Fraction(sum(r[i] * r[j] for r in off), n * n)
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= abs(exact) * Fraction(1, 2**75) + Fraction(1, 2**60)


def test_eigenvectors_of_close_values():
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    values = np.sort(1 + 1e-7 * rng.random(30))[::-1]
    high = (turn * values) @ turn.T
    found, axes = whitening.eigen((high + high.T) / 2, np.zeros((30, 30)))
    assert np.allclose(axes.T @ axes, np.eye(30), atol=1e-14) and np.allclose(found, values, rtol=1e-14)
    residual = ((high + high.T) / 2).astype(np.longdouble) @ axes - axes * found
    assert np.abs(residual).max() < 1e-15


def test_parts_merge_in_several_steps(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    made = vectors(120, dims=4)
    one = whitening.whiten(spark.createDataFrame(made, VECTORS).coalesce(1)).orderBy("vec_id", "component").toPandas()
    many = whitening.whiten(spark.createDataFrame(made, VECTORS).repartition(9)).orderBy("vec_id", "component").toPandas()
    assert np.allclose(one["whitened"], many["whitened"], atol=1e-13)
