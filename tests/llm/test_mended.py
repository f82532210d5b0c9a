"""Spans of notices against brute force, class names of pages, and columns with odd names."""

import random

import pytest

from framelake.llm import exact_dedup, html_extract, license_scan, mixing, near_dedup, packing, quality


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_spans(text, notices):
    """All stretches of whole words within the edits of a notice; of overlapping ones of a notice, the one of fewest edits first."""
    words = license_scan.normalised_words(text)
    at = [i for i, c in enumerate(words) if c == " "]
    out = []
    for k, notice in enumerate(notices):
        found = sorted((e, a, b) for a in at for b in at if 0 < b - a - 1 <= len(notice.phrase) + notice.edits and (e := edits(words[a + 1 : b], notice.phrase)) <= notice.edits)
        kept = []
        for e, a, b in found:
            if all(b <= c or d <= a for _, c, d in kept):
                kept.append((e, a, b))
        out += [(a, b, k, e) for e, a, b in kept]
    return sorted(out)


def mutated(rng, phrase):
    letters = list(phrase)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(letters))
        letters[k : k + rng.randrange(2)] = rng.choice(["", "k", " ", "xy", letters[k]])
    return "".join(letters)


def test_notices_against_brute_force():
    rng = random.Random(11)
    notices = (license_scan.Notice("general public license", "gpl", 2), license_scan.Notice("all rights reserved", "reserved", 2), license_scan.Notice("licensed under cc by", "cc-by", 3))
    scanner = license_scan.Scanner(license_scan.BASE, notices)
    total = 0
    for _ in range(150):
        parts = [mutated(rng, rng.choice(notices).phrase) if rng.random() < 0.7 else rng.choice(["x", "general", "license rights", "é y"]) for _ in range(rng.randrange(1, 6))]
        text = " ".join(parts)
        want = plain_spans(text, notices)
        assert scanner.fuzzy(license_scan.normalised_words(text)) == want, text
        total += len(want)
    assert total > 150


@pytest.mark.parametrize(("text", "spans"), [("general publik license general public license", 2), ("x general publik license y general public license z generl public licence", 3)])
def test_neighbouring_notices_are_all_found(text, spans):
    assert len(license_scan.Scanner(license_scan.BASE, license_scan.NOTICES).scan(text)[-1]) == spans


CLASSES = [
    ('<div class="content with-sidebar"><p>One long text.</p></div>', "One long text."),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Body.</p></article>', "Title\n\nBody."),
    ('<article><p class="market-share">Shares fell.</p><p class="comment">He said no.</p></article>', "Shares fell.\n\nHe said no."),
    ('<div class="comments"><p>All there is.</p></div>', "All there is."),
    ('<article><p>Body.</p></article><div class="ad">Buy.</div><div class="comments"><article><p>First!</p></article></div>', "Body."),
]


@pytest.mark.parametrize(("page", "text"), CLASSES)
def test_class_names_do_not_empty_a_page(page, text):
    assert html_extract.blocks_of(html_extract.parsed(page), html_extract.NONE) == text


def test_template_confirms_class_names_inside_an_article(spark):
    page = '<html><body><nav><a href="/">Start</a></nav><article><h1>Title {n}</h1><p>Words of page {n} and many more of it to read, {n} times.</p>{odd}<div class="comments"><p>Nice {n}, said reader {n}</p></div></article></body></html>'
    rows = [(i, f"http://c.example.com/{i}", page.format(n=i, odd='<p class="comment">He said so.</p>' if i == 2 else "")) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Title 1\n\nWords of page 1 and many more of it to read, 1 times."
    assert got[2].endswith("He said so.") and "Nice" not in got[2]


def test_columns_with_odd_names(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, "en", "s", 180, "x", "y"), (2, "a b c " * 30, "en", "s", 180, "x", "z"), (3, None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c``d` string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for made in (exact_dedup.exact_dedup(docs), near_dedup.near_dedup(docs), mixing.mixed(docs), quality.quality_filter(docs, labels)):
        assert made.columns == docs.columns and made.collect() is not None
    assert {r["a.b"] for r in exact_dedup.exact_dedup(docs).collect()} == {"x", None}


def test_a_large_bucket_loses_no_link(spark, monkeypatch):
    """40 pairs of similar texts and 20 other texts meet in one bucket only, and stand apart in its order."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(9000)}" for _ in range(30)] for _ in range(60)]
    texts += [[*t[:k], f"x{k}", *t[k + 1 :]] for k, t in zip(range(30), texts, strict=False)] + [t[1:] for t in texts[30:40]]
    rows = []
    for rid, words in enumerate(texts):
        bins = [0] * near_dedup.BINS
        for w in words:
            bins[sum(w.encode()) * 37 % near_dedup.BINS] += 1
        rows.append((rid, len(words), bins, [5, *(rng.getrandbits(62) for _ in range(near_dedup.SKETCHES - 1))], " ".join(words)))
    df = spark.createDataFrame(rows, "rid long, n long, bins array<int>, sketch array<long>, text string")
    got = {r.node: r.component for r in near_dedup.linked(df.select("rid", "n", "bins", "sketch"), df.select("rid", "text")).collect()}
    assert got == {end: i for i in range(40) for end in (i, 60 + i)}


def test_every_white_space_is_one_space():
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert html_extract.blocks_of(html_extract.parsed("<p>" + "".join(f"a{s} {s}" for s in spaces) + "</p>"), html_extract.NONE) == " ".join("a" * len(spaces))


def test_texts_go_only_where_a_pair_is_possible(spark, monkeypatch):
    """300 different texts in one bucket, and one pair: two members get their texts, whatever the bucket's size."""
    rng, seen, plain = random.Random(8), {}, near_dedup.counted

    def counted(df, name, *more):
        seen[name] = plain(df, name, *more)
        return seen[name]

    monkeypatch.setattr(near_dedup, "counted", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", 1000)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(300)]
    texts.append(["new", *texts[7][1:]])
    bins = [[0] * near_dedup.BINS for _ in texts]
    for b, words in zip(bins, texts, strict=True):
        for w in words:
            b[int(w[1:]) % near_dedup.BINS if w != "new" else 0] += 1
    rows = [(rid, 40, b, 5, rid, " ".join(words)) for rid, (b, words) in enumerate(zip(bins, texts, strict=True))]
    df = spark.createDataFrame(rows, "rid long, n long, bins array<int>, bucket long, rid_part long, text string")
    got = near_dedup.apart(df.select("bucket", "rid", "n", "rid_part"), df.select("rid", "n", "bins"), df.select("rid", "text")).collect()
    assert [{r.a, r.b} for r in got] == [{7, 300}]
    assert seen["possible"]._seen[0] == seen["wanted"]._seen[0] == 2


def test_rows_of_a_bucket_grow_with_its_members(spark, monkeypatch, tmp_path):
    """All members are apart: twice as many send twice as many rows, not four times as many, and no pair is lost."""
    plain = near_dedup.possible

    def watched(blocks):
        (tmp_path / f"{len(blocks[blocks['left']])}-{blocks['bucket'].iloc[0]}-{blocks['i'].iloc[0]}-{blocks['j'].iloc[0]}").write_text(str(len(blocks)))
        return plain(blocks)

    monkeypatch.setattr(near_dedup, "possible", watched)
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    rng, sent = random.Random(12), {}
    for members in (300, 600):
        texts = [[f"w{rng.randrange(10**6)}" for _ in range(20)] for _ in range(members - 50)]
        texts += [["new", *t[1:]] for t in texts[:50]]
        rows = []
        for rid, words in enumerate(texts):
            bins = [0] * near_dedup.BINS
            for w in words:
                bins[int(w[1:]) % near_dedup.BINS if w != "new" else 0] += 1
            rows.append((rid, 20, bins, members, rid, " ".join(words)))
        df = spark.createDataFrame(rows, "rid long, n long, bins array<int>, bucket long, rid_part long, text string")
        got = near_dedup.apart(df.select("bucket", "rid", "n", "rid_part"), df.select("rid", "n", "bins"), df.select("rid", "text")).collect()
        assert sorted(sorted((r.a, r.b)) for r in got) == [[i, members - 50 + i] for i in range(50)]
        sent[members] = sum(int(p.read_text()) for p in tmp_path.glob(f"*-{members}-*"))
    assert 0 < sent[600] <= 2.1 * sent[300] and sent[600] <= 2 * 16 * 600


def test_texts_are_aligned_in_parts(monkeypatch):
    """Parts of few words hold every possible pair once, with both of its members."""
    import numpy as np
    import pandas as pd

    rng = random.Random(13)
    n = [rng.randrange(8, 12) for _ in range(40)]
    bins = [np.bincount(np.arange(k) % 9, minlength=near_dedup.BINS).astype(np.int32) for k in n]
    rows = [(5, 0, 0, left, rid, rid, True, n[rid], bins[rid], np.array([5])) for left in (True, False) for rid in range(40)]
    blocks = pd.DataFrame(rows, columns=["bucket", "i", "j", "left", "rid", "rid_part", "rest", "n", "bins", "buckets"])
    pairs = lambda x: sorted((r.rid, o) for r in x[x["left"]].itertuples() for o in r.others.tolist())
    whole = near_dedup.possible(blocks)
    assert set(whole["k"]) == {0} and len(pairs(whole)) > 300
    monkeypatch.setattr(near_dedup, "AT_ONCE_WORDS", 60)
    cut = near_dedup.possible(blocks)
    assert pairs(cut) == pairs(whole) and cut["k"].nunique() > 10
    for _, x in cut.groupby("k"):
        right = x[~x["left"]]["rid"].tolist()
        assert len(right) == len(set(right)) and {o for _, o in pairs(x)} == set(right)
        assert all(sum(n[i] for i in side["rid"].unique()) <= 60 + max(n) for _, side in x.groupby("left"))
    assert len(cut) <= 2 * 40 * 7 + 80
    assert near_dedup.possible(blocks[blocks["left"]]).empty


def test_a_batch_is_sketched_in_parts(spark, monkeypatch):
    """A worker's memory follows a part of a batch, not the batch; rows and their order stay, a text of any length is whole, a batch may be empty."""
    import tracemalloc

    import pandas as pd

    df, made = spark.createDataFrame([(0, 0, "a")], "rid long, id long, text string"), []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: made.append(f) or self)
    near_dedup.sketched(df)
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(2000)] + [" ".join(f"v{i}" for i in range(20_000)), ""]
    batch = pd.DataFrame({"rid": range(len(texts)), "id": [str(i) for i in range(len(texts))], "text": texts})
    tracemalloc.start()
    try:
        n, rids = [], []
        for out in made[0](iter([batch, batch[:0]])):
            n += out["n"].tolist()
            rids += out["rid"].tolist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rids == list(range(2002)) and n == [300] * 2000 + [20_000, 0]
    assert peak < 32 << 20, peak


def test_more_links_join_components(spark):
    from framelake.operators.components import connected_components, merged
    from framelake.plans.tables import counted

    rng = random.Random(9)
    some, more = ([(rng.randrange(300), rng.randrange(300)) for _ in range(k)] for k in (90, 60))
    frame = lambda x: counted(spark.createDataFrame(x, "a long, b long"), "links")
    parts = counted(connected_components(frame(some)), "parts")
    assert merged(parts, frame([])) is parts
    got = {r.node: r.component for r in merged(parts, frame(more)).collect()}
    want = {r.node: r.component for r in connected_components(frame(some + more)).collect()}
    assert got == want and len(want) > 100


def test_each_run_of_a_batch_is_cut_once():
    import public_tokenizers

    own, calls = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    cut, own.cut = own.cut, type("Cut", (), {"findall": lambda _, x: calls.append(x) or cut.findall(x)})()
    rng = random.Random(5)
    texts = ["", " ", "a  b\t\x0b\x0c\rc ", "12ab34...!?x", "ÀÉ×÷ß  x", "ÿÖ9ö", "x\x1cy a\x85b", "It's 'a", "<|endoftext|> a", " end, end, end,\nEND,"]
    texts += ["".join(rng.choice("abXY09 .,-\n\tÀé") for _ in range(rng.randrange(60))) for _ in range(500)]
    want = [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want
    assert len(calls) == len(set(calls)) and "end," in calls and not any(" " in x for x in calls)


def test_a_known_piece_is_not_cut_again():
    import public_tokenizers

    own, calls = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), []
    cut, own.cut = own.cut, type("Cut", (), {"findall": lambda _, x: calls.append(x) or cut.findall(x)})()
    first, again = ["... 7 end ... x,"], ["x, ... 7 end 78 ...", "... it"]
    want = [[e.ids for e in own.tokenizer.encode_batch_fast(x, add_special_tokens=False)] for x in (first, again)]
    assert [[x.tolist() for x in own.encode(texts)] for texts in (first, again)] == want
    assert sorted(calls) == ["...", "7", "78", "x,", "x,"]


def test_plain_pieces_skip_the_normaliser():
    import public_tokenizers

    own, rng = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), random.Random(14)
    texts = ["".join(rng.choice("abcxyzABÀÉØöÿéß0189.,;-_<|>[]{}~^`  \n\t") for _ in range(rng.randrange(80))) for _ in range(3000)]
    want = [e.ids for e in own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    own.tokenizer = type("None", (), {"encode_batch_fast": lambda _, x, **more: x and 1 / 0 or []})()
    assert [x.tolist() for x in own.encode(texts)] == want
