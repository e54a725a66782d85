"""The registered queries and the pipeline over the small tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gaugewise.llm import queries as own
from gaugewise.llm import simhash
from gaugewise.llm.common import table, written

from .fixtures import empty, odd, words
from .test_operators import simhash_by_hand

SF = "/root/testdata/sf0.001"


def test_one_query_an_operator():
    assert [q.split("_")[0] for q in own.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(own.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = own.QUERIES[name](spark, SF)
    want = con.sql(own.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [df.columns.index(c) for c in want.columns]
    assert Counter(tuple(r[i] for i in order) for r in df.collect()) == Counter(want.fetchall())


def test_contract_columns(spark):
    want = {
        "op2": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op3": ["doc_id", "held_out", "score", "predicted"], "op4": ["doc_id", "size", "source_size", "target", "taken"],
        "op5": ["doc_id", "held_out", "lang_pred", "score"], "op6": ["doc_id", "fingerprint", "component_id"], "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op8": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], "op9": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op10": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op12": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op13": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    }
    for name in want:
        query = next(q for k, q in own.QUERIES.items() if k.startswith(f"{name}_"))
        assert query(spark, SF).columns[: len(want[name])] == want[name]


def alike_by_hand(rows):
    """The ids that stay: every pair of texts is compared by all fingerprints."""
    budget = simhash.by_similarity(0.8)
    fps = [simhash.several((r.text or "").encode()) for r in rows]
    assert all(f[0] == simhash_by_hand(r.text or "", 5) for f, r in zip(fps, rows))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(fps):
        for j, y in enumerate(fps[:i]):
            apart = [(a ^ b).bit_count() for a, b in zip(x, y)]
            if min(apart) == 0 or min(apart) <= budget.bits and sum(apart) <= budget.total:
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return least.values()


def test_near_copies_by_similarity(spark):
    """Copies with one word in 60 changed (about 0.85 alike) go, others with one in 12 (0.4) stay; large groups, odd rows, nothing."""
    rows = []
    for n, every in enumerate((60, 60, 60, 12, 12)):
        base = words(600, 100 + n).split()
        rows += [(10 * n, " ".join(base)), (10 * n + 1, " ".join("new" + w if i % every == every // 2 else w for i, w in enumerate(base)))]
    base = words(400, 7).split()
    rows += [(1000 + k, " ".join("x" + w if i == 7 * k else w for i, w in enumerate(base))) for k in range(57)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string"), "t")
    got = {r.doc_id for r in simhash.representatives(df).collect()}
    assert got == set(alike_by_hand(df.collect())) and {i for i in got if i < 1000} == {0, 10, 20, 30, 31, 40, 41} and {i for i in got if i >= 1000} == {1000}
    table_ = written(odd(spark), "t")
    assert simhash.representatives(table_).columns == table_.columns
    assert simhash.representatives(written(empty(spark), "t")).count() == 0


def test_stages_on_odd_and_empty_tables(spark):
    for df in (odd(spark), empty(spark)):
        docs = written(df, "t")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), "t")
            assert docs.columns == df.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() == docs.count() and (docs.count() > 0) == (df.count() > 0)


def test_pipeline_by_stage(spark):
    docs = table(spark, SF, "documents")
    kinds = dict(docs.dtypes)
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    a = written(stages["toxicity"](spark, docs, SF), "t")
    assert dict(a.dtypes) == kinds and 0.8 * len(before) < a.count() <= len(before)
    b = written(stages["exact dedup"](spark, a, SF), "t")
    best = {}
    for r in a.collect():
        best[r.text] = max(best.get(r.text, r), r, key=lambda x: x.doc_id)
    assert Counter(r.doc_id for r in b.collect()) == Counter(r.doc_id for r in best.values())
    c = written(stages["simhash near-dedup"](spark, b, SF), "t")
    kept = c.collect()
    assert Counter(r.doc_id for r in kept) == Counter(alike_by_hand(b.collect()))
    d = written(stages["mixing"](spark, c, SF), "t")
    times = Counter(r.doc_id for r in d.collect())
    assert dict(d.dtypes) == kinds and max(times.values()) <= 3 and set(times) <= {r.doc_id for r in kept}
    e = stages["byte-level BPE"](spark, d, SF)
    assert Counter(r.doc_id for r in e.collect()) == times
    assert corpus_pipeline.run(spark, SF).count() == sum(times.values())
