"""run() of the pipeline against plain versions of its stages; near-duplicates in a large group against all pairs."""

import collections
import random

import pytest

from framelake.llm import near_dedup
from test_llm import encoder_once, fixture_rows, multiset, plain_quality


def test_run_against_plain_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [r[:5] for r in fixture_rows()]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good = [r for r in rows if not plain_quality(r[1])[5]]  # too few labels for a cutoff
    key = lambda r: (r[0] is not None, r[0] or 0)
    once = {}
    for r in sorted(good, key=key):
        once[r[1]] = r  # of equal texts the largest id stays
    kept = []
    for r in sorted(once.values(), key=key):  # the smallest id of each class stays; classes of the fixture are stars around it
        if not any(near_dedup.similar(near_dedup.words_of(r[1]), near_dedup.words_of(k[1])) for k in kept):
            kept.append(r)
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(kept, schema), str(tmp_path)).collect()
    own = encoder_once()
    want = multiset((r.doc_id, own.encode_ordinary(r.text)) for r in mixed)
    assert multiset((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want and len(kept) < len(once) < len(good)


def test_a_large_group_of_near_copies_against_all_pairs(spark):
    """1,000 texts around three centres, most within the threshold of their centre, some of each other only: classes by all pairs."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(9000)}"
    centres = [[word() for _ in range(80)] for _ in range(3)]
    texts = []
    while len(texts) < 1000:
        t = list(rng.choice(centres))
        for k in rng.sample(range(80), rng.choice((1, 3, 6, 9, 12, 15, 18, 22))):
            t[k] = word()
        texts.append(t)
    at = list(range(len(texts)))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    counts = [collections.Counter(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and sum((counts[i] & counts[j]).values()) >= 64 and near_dedup.similar(texts[i], texts[j]):
                at[find(i)] = find(j)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    apart = {(find(i), got[i]) for i in range(len(texts))}
    classes = len({find(i) for i in range(len(texts))})
    lost = len({c for _, c in apart}) - classes
    print(f"{classes} classes by all pairs, {lost} of them in more than one part")
    assert lost <= 0.002 * len(texts)
    assert len(apart) == len({c for _, c in apart})  # none joins two
