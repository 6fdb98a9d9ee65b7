"""The pipeline's stages in turn, against a brute-force version of the whole."""

import random

import corpus_pipeline
from gossamer.llm.queries import QUERIES

from .conftest import varied
from .test_rows import brute_secrets, packed_right
from .test_search import brute_copies, brute_lines


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    rows = varied(120, seed=14)
    rows = [(i, t + (" wretch vermin wretch vermin" if i % 9 == 4 else "") + (f"\nthe setting here is token={'ab12' * 4} for now" if i % 11 == 3 else "")) for i, t in rows]
    rng.shuffle(rows)
    toxic = {i for i, t in rows if "wretch" in t}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {i: t for i, t in rows if i not in toxic}
    gone = brute_lines(list(left.items()))
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, t in left.items()}
    ids = sorted(left)
    group = brute_copies([left[i] for i in ids])
    left = {i: left[i] for n, i in enumerate(ids) if group[n] == n}
    masked = {}
    for i, t in left.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_secrets(t).split(",") if s]
        for a, b in sorted(spans, reverse=True):
            t = t[:a] + "[REDACTED]" + t[b:]
        masked[i] = t
    assert {r.doc_id for r in got} == set(masked) and any("[REDACTED]" in t for t in masked.values())
    packed_right(got, masked, 2048)


def test_stages_keep_columns_and_bear_edges(spark, edges, nothing, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == edges.columns, name
            path = f"{tmp_path}/{name}-{len(docs.columns)}-{id(docs)}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_every_query_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
