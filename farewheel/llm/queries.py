"""The registered queries of the operators, with the parameters of production runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farewheel.llm import (
    fair_mixing, fm_dedup, impact_topk, importance_resampling, langid_fusion, paragraph_iblt, prefix_forest, quality_gam,
    rank_array_bpe, simhash_trie, token_planes, toxicity_pu, trie_join,
)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op2_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_pu.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.write_and_read(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=2)


def op4_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeats(documents(spark, sf_dir))


def op5_langid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_fusion.identify(table(spark, sf_dir, "pages"), documents(spark, sf_dir))


def op6_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = fair_mixing.mix_documents(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk.top_k_embeddings(table(spark, sf_dir, "embeddings"))


def op8_paragraph_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_iblt.fingerprint_versions(documents(spark, sf_dir))


def op9_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.jaccard_components(documents(spark, sf_dir))


def op10_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_array_bpe.bpe_encode(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), digests=True)


def op11_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_components(documents(spark, sf_dir))


QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_toxicity_pu": op2_toxicity_pu,
    "op3_token_planes": op3_token_planes,
    "op4_fm_dedup": op4_fm_dedup,
    "op5_langid_fusion": op5_langid_fusion,
    "op6_fair_mixing": op6_fair_mixing,
    "op7_impact_topk": op7_impact_topk,
    "op8_paragraph_iblt": op8_paragraph_iblt,
    "op9_trie_join": op9_trie_join,
    "op10_rank_array_bpe": op10_rank_array_bpe,
    "op11_prefix_forest": op11_prefix_forest,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_simhash_trie": op13_simhash_trie,
}

_REPEATS = r"""
WITH texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS place FROM texts WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS window_ FROM places
), first AS (
  SELECT window_, min(doc_id) AS doc_id FROM windows GROUP BY window_
), gone AS (
  SELECT doc_id, list(DISTINCT place) AS gone FROM (
    SELECT windows.doc_id, unnest(range(windows.place, windows.place + 13)) AS place
    FROM windows JOIN first ON windows.window_ = first.window_ AND first.doc_id < windows.doc_id
  ) GROUP BY doc_id
), kept AS (
  SELECT texts.doc_id, words, CASE WHEN gone IS NULL THEN words ELSE
    list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END AS kept
  FROM texts LEFT JOIN gone ON texts.doc_id = gone.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(kept))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM kept
"""

_MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT source, source_size, 2 * source_size::DOUBLE AS most,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sources
), filled AS (
  SELECT *, coalesce(sum(most) OVER earlier, 0) AS fixed, sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         1.5 * sum(source_size) OVER () AS wanted
  FROM weighed WINDOW earlier AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), capped AS (
  SELECT *, weight * (wanted - fixed) / open_weight >= most AS full_up FROM filled
), rest AS (
  SELECT any_value(wanted) - coalesce(sum(CASE WHEN full_up THEN most END), 0) AS words,
         sum(CASE WHEN NOT full_up THEN weight END) AS open_weight
  FROM capped
), targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN most ELSE least(most, weight * words / rest.open_weight) END AS target
  FROM capped, rest
), queued AS (
  SELECT doc_id, source, size, round, md5('mix:' || round || ':' || coalesce(doc_id::VARCHAR, '')) AS ticket,
         sum(size) OVER (PARTITION BY source ORDER BY round, md5('mix:' || round || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS queued
  FROM sizes, (VALUES (0), (1)) AS r(round) WHERE size > 0
), taken AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY queued / target, ticket, round, doc_id, size ROWS UNBOUNDED PRECEDING) AS total
  FROM queued JOIN targets ON queued.source IS NOT DISTINCT FROM targets.source
), mixed AS (
  SELECT doc_id, sum(size) AS taken FROM taken WHERE total <= (SELECT sum(target) FROM targets) GROUP BY doc_id
)
SELECT sizes.doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source LEFT JOIN mixed ON sizes.doc_id = mixed.doc_id
"""

_TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_JACCARD = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
  FROM texts
), rows_ AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS start, doc_id AS there FROM sets
  UNION SELECT reach.start, links.b FROM reach JOIN links ON reach.there = links.a
)
SELECT sets.doc_id, len(any_value(shingles))::BIGINT AS n_shingles, min(there) AS component_id
FROM sets JOIN reach ON sets.doc_id = reach.start GROUP BY sets.doc_id
"""

def _crc32(bytes_: str) -> str:
    """CRC-32 of a list of byte values; 3988292384 is the reversed polynomial (fixed value)."""
    one_bit = "lambda k, z: xor(k >> 1, CASE WHEN k & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)"
    one_byte = f"lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], {one_bit})"
    return f"xor(list_reduce([4294967295::BIGINT] || {bytes_}, {one_byte}), 4294967295::BIGINT)"


_TRIE = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS lender, {_crc32("[ord(x)::BIGINT for x in string_split(c::VARCHAR, '')]")} % 6 AS h FROM turns GROUP BY c
), heads AS (
  SELECT convs.c, t.place AS d, t.role, t.text FROM convs JOIN turns t ON t.c = convs.lender AND t.place <= convs.h
), lent AS (
  SELECT convs.c, h, count(heads.c) AS taken FROM convs LEFT JOIN heads ON heads.c = convs.c GROUP BY convs.c, h
), rebuilt AS (
  SELECT * FROM heads
  UNION ALL SELECT t.c, taken + place - h, t.role, t.text FROM turns t JOIN lent ON lent.c = t.c AND place > h
), sequences AS (
  SELECT lent.c, coalesce(list({{'role': role, 'text': text}} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS turns
  FROM lent LEFT JOIN rebuilt ON rebuilt.c = lent.c GROUP BY lent.c
), prefixes AS (
  SELECT c, d, len(turns) AS whole, md5(concat('#', (turns[1:d])::VARCHAR)) AS path, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].text) END AS size
  FROM sequences, unnest(range(0, len(turns) + 1)) AS r(d)
), named AS (
  SELECT *, min(c) OVER (PARTITION BY d, path) AS m FROM prefixes
), nodes AS (
  SELECT m, d, count(*) AS n, any_value(size) AS size, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = whole) AS ends FROM named GROUP BY m, d
), above AS (
  SELECT nodes.*, named.m AS parent FROM nodes LEFT JOIN named ON named.c = nodes.m AND named.d = nodes.d - 1
), children AS (
  SELECT parent AS m, d - 1 AS d, count(*) AS n FROM above WHERE parent IS NOT NULL GROUP BY parent, d - 1
), family AS (
  SELECT up.m, up.d, sum((nodes.n - 1) * nodes.size) AS saved, count(*) FILTER (WHERE children.m IS NULL) AS leaves
  FROM nodes JOIN named up ON up.c = nodes.m AND up.d <= nodes.d LEFT JOIN children ON children.m = nodes.m AND children.d = nodes.d
  GROUP BY up.m, up.d
)
SELECT above.m AS conv_id, above.d::BIGINT AS depth, parent AS parent_conv_id, above.n::BIGINT AS n_convs, coalesce(children.n, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM above JOIN family ON family.m = above.m AND family.d = above.d LEFT JOIN children ON children.m = above.m AND children.d = above.d
"""

_RESAMPLE = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), features AS (
  SELECT doc_id, unnest(words) AS word FROM texts
), hashed AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM features UNION SELECT word FROM wanted)
), buckets AS (
  SELECT word, {_crc32("[('0x' || h[2 * i + 1:2 * i + 2])::BIGINT for i in range(len(h) // 2)]")} % 10000 AS bucket FROM hashed
), source AS (
  SELECT bucket, count(*) AS s FROM features JOIN buckets USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM wanted JOIN buckets USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM source)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(target.t, 0) + 1)::DOUBLE * (totals.s + 10000) / ((source.s + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket), totals
), weights AS (
  SELECT doc_id, sum(gain) AS weight FROM features JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT texts.doc_id, len(words) AS n, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || texts.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights ON weights.doc_id = texts.doc_id
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n >= 20
)
SELECT scored.doc_id, n::BIGINT AS n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM ranked) * 10 // 100 THEN place::BIGINT END AS rank
FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op4_fm_dedup": _REPEATS,
    "op6_fair_mixing": _MIX,
    "op7_impact_topk": _TOP_K,
    "op9_trie_join": _JACCARD,
    "op11_prefix_forest": _TRIE,
    "op12_importance_resampling": _RESAMPLE,
}
