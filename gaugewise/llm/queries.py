"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewise.llm import byte_bpe, chaining, exact_dedup, fill_in_middle, language_id, lm_scoring, mixing, progressive_jpeg, simhash, suffix_dedup, toxicity, vector_codes, warc
from gaugewise.llm.common import table


def op1_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.linked_documents(table(spark, sf_dir, "documents"))


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op5_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op8_two_stage_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_jpeg.media(table(spark, sf_dir, "documents"))


def op10_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_wavelet_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(table(spark, sf_dir, "documents"), with_output=False)


def _codes_twin(entries: int = 256, rounds: int = 4, parts: int = 4) -> str:
    """Rounds of assignment and means over parts, one common table a step."""
    nearest = """
        SELECT vec_id, p, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
            SELECT k.vec_id, k.p, k.x, c.entry, list_sum(list_transform(list_zip(k.x, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM pieces k JOIN codebook{r} c ON k.p = c.p) GROUP BY ALL"""
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"pieces AS (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS t(p))",
        f"codebook0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS e FROM pieces QUALIFY entry < {entries})",
    ]
    for r in range(rounds):
        steps += [
            f"assigned{r} AS ({nearest.format(r=r)})",
            f"means{r} AS (SELECT p, entry, i, sum(v) AS s, count(*) AS n FROM (SELECT p, entry, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM assigned{r}) GROUP BY ALL)",
            f"centres{r} AS (SELECT p, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM means{r} GROUP BY ALL)",
            f"codebook{r + 1} AS (SELECT c.p, c.entry, coalesce(m.e, c.e) AS e FROM codebook{r} c LEFT JOIN centres{r} m ON c.p = m.p AND c.entry = m.entry)",
        ]
    return f"""WITH {", ".join(f"{s.replace(' AS ', ' AS MATERIALIZED ', 1)}" for s in steps)}, last AS ({nearest.format(r=rounds)}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, entry)) FROM codebook{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collinear_chaining": op1_collinear_chaining,
    "op2_lattice_likelihood": op2_lattice_likelihood,
    "op3_noisy_channel_toxicity": op3_noisy_channel_toxicity,
    "op4_block_mixing": op4_block_mixing,
    "op5_ecoc_language_id": op5_ecoc_language_id,
    "op6_simhash_trie": op6_simhash_trie,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_two_stage_suffix": op8_two_stage_suffix,
    "op9_progressive_jpeg": op9_progressive_jpeg,
    "op10_heavy_hitter_dedup": op10_heavy_hitter_dedup,
    "op11_hadamard_codes": op11_hadamard_codes,
    "op12_warc_segments": op12_warc_segments,
    "op13_wavelet_fim": op13_wavelet_fim,
}

ORACLE_SQL: dict[str, str] = {
    "op10_heavy_hitter_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_hadamard_codes": _codes_twin(),
    "op12_warc_segments": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
        SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM p""",
    "op13_wavelet_fim": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || doc_id) AS h FROM documents),
        d AS (SELECT *, len(tokens) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS r FROM t),
        c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        s AS (SELECT *, array_to_string(tokens[1 : a], '') AS prefix, array_to_string(tokens[a + 1 : b], '') AS middle, array_to_string(tokens[b + 1 : n], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM s""",
}
