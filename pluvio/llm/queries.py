"""The numbered operators applied to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.functions.joins import lookup
from pluvio.llm import (
    bpe,
    decontamination,
    embedding_join,
    labelled,
    merkle,
    ngram_join,
    pii,
    quality,
    secrets,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_codes,
    warc,
)
from pluvio.llm.common import kept, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    codec = bpe.SharedCodec(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = bpe.decode(bpe.encode(docs, codec), codec)
    return tokens.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 512 tokens."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    )
    counted = token_counts.count_tokens(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of ten-word benchmark windows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op1_decontamination"] = r"""
WITH lowered AS (
    SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark
), items AS (
    SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered WHERE t IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size,
           list_slice(w, i, i + least(len(w), 10) - 1) AS win
    FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0
), texts AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), places AS (
    SELECT row_id, s.size, i, list_slice(w, i, i + s.size - 1) AS win
    FROM texts, (SELECT DISTINCT size FROM windows) s, unnest(range(1, len(w) - s.size + 2)) AS r(i)
), hits AS (
    SELECT row_id, i, size, item_id FROM places JOIN windows USING (size, win)
), hit_words AS (
    SELECT row_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + size)) AS r(k) GROUP BY row_id
), hit_items AS (
    SELECT row_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
    FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words USING (row_id) LEFT JOIN hit_items USING (row_id)
"""


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with those that only the corpus shows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.scan(docs)

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(named, ",")

    base = F.filter("secrets", lambda s: s["kind"] != "owned")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        F.size(F.filter("secrets", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("secrets", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
    )


_SECRET_PATTERNS = (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.WIDE)
_PARTS = r"""
    SELECT row_id, source, repository, '{kind}' AS kind, {rank} AS rank, unnest(pieces) AS part, generate_subscripts(pieces, 1) AS k
    FROM (SELECT row_id, source, repository, string_split(
              regexp_replace(t, '{pattern}', chr(57344) || '\0' || chr(57344), 'g'), chr(57344)) AS pieces FROM texts)
"""
ORACLE["op4_secrets"] = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, source, {{'doc': doc_id, 'text': md5(text)}} AS repository,
           replace(coalesce(text, ''), chr(57344), chr(57345)) AS t
    FROM documents
), parts AS (
    {" UNION ALL ".join(_PARTS.format(kind=kind, rank=rank, pattern=pattern.replace("'", "''")) for rank, (kind, pattern) in enumerate(zip(secrets.KINDS, _SECRET_PATTERNS)))}
), placed AS (
    SELECT *, CAST(sum(length(part)) OVER (PARTITION BY row_id, kind ORDER BY k) AS BIGINT) AS stop FROM parts
), found AS (
    SELECT *, stop - length(part) AS start,
           CASE WHEN kind = 'assign' THEN regexp_extract(part, '{secrets.ASSIGN.replace("'", "''")}', 2) ELSE part END AS value
    FROM placed WHERE k % 2 = 0
), kept AS (
    SELECT * FROM found
    WHERE CASE kind WHEN 'assign' THEN length(value) >= 12
                    WHEN 'owned' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') ELSE true END
), owners AS (
    SELECT value, CASE WHEN count(*) >= {secrets.EXAMPLE_OWNERS} OR sum(r) >= {secrets.EXAMPLE_REPOSITORIES} THEN 'example'
                       WHEN count(*) = 1 THEN 'live' ELSE 'shared' END AS verdict
    FROM (SELECT value, source, count(*) AS r FROM (SELECT DISTINCT value, source, repository FROM kept) GROUP BY value, source)
    GROUP BY value
), judged AS (
    SELECT kept.*, verdict, kind || ':' || start || ':' || stop AS span FROM kept JOIN owners USING (value)
    WHERE kind <> 'owned' OR verdict = 'live'
), summed AS (
    SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'owned') AS base,
           string_agg(span, ',' ORDER BY start, rank) AS spans,
           count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
    FROM judged GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM texts LEFT JOIN summed USING (row_id)
"""


# Of the registered queries only; a user of the operator brings a secret one.
PII_KEY = "registered query"


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal values replaced by pseudonyms of the same format."""
    return pii.pseudonymise(read(spark, sf_dir, "documents"), PII_KEY, found="n_replaced")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return _with_fold(scored, 0.5)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return _with_fold(scored, 0.3)


def _with_fold(scored: DataFrame, threshold: float) -> DataFrame:
    # the score is computed once, before it is compared
    return scored.select(
        "doc_id",
        labelled.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every vector at a cosine of 0.9 or more, and the components they make."""
    found = embedding_join.near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


ORACLE["op5_embedding_join"] = """
WITH RECURSIVE pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT reached.a, pairs.b FROM reached JOIN pairs ON reached.b = pairs.a
)
SELECT a AS vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = reached.a) AS n_links, min(b) AS component_id,
       min(b) = a AS kept
FROM reached GROUP BY a
"""


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles reach a Jaccard similarity of 0.9."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_join.classes(docs, words=3, num=90, den=100)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that strings of 400 bytes occurring twice cover, and what is left."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    cut = suffix_dedup.remove_repeats(docs.withColumn("n_bytes", n_bytes))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("deduplicated.kept")).alias("n_removed"),
        F.size("deduplicated.spans").cast("long").alias("n_spans"),
        F.sha2("deduplicated.kept", 256).alias("kept_sha256"),
    )


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a document with one character more in its count still verifies."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")

    def leaf(n_chars: Column) -> Column:
        return merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    n_chars = F.col("n_chars").cast("long")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    built = merkle.manifest(
        docs, leaf(n_chars), F.col("doc_id"), F.col("lang"), altered=F.when(tampered, leaf(n_chars + 1))
    )
    siblings = F.array_join(F.transform("proof", lambda s: s["sibling"]), "")
    return built.proofs().select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        merkle.fold(F.coalesce("altered", "leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE["op11_merkle_manifest"] = r"""
WITH RECURSIVE crc_table AS (
    SELECT n, n AS c, 0 AS k FROM range(256) AS r(n)
    UNION ALL
    SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_table WHERE k < 8
), crc AS (
    SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s, 0 AS k, 4294967295 AS c FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT s, crc.k + 1, xor(crc.c >> 8, t.c) FROM crc JOIN crc_table t
    ON t.k = 8 AND t.n = xor(crc.c, ascii(s[crc.k + 1])) % 256 WHERE crc.k < length(s)
), fields AS (
    SELECT doc_id, lang, n_chars,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS a,
           coalesce(strlen(text) || ':' || text, '-') AS b,
           n_chars + CASE WHEN xor(c, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS m
    FROM documents LEFT JOIN crc ON s = CAST(doc_id AS VARCHAR) AND k = length(s)
), leaves AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS key,
           sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || b) AS leaf,
           sha256(a || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-') || b) AS altered
    FROM fields
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
           count(*) OVER (PARTITION BY key) AS n
    FROM leaves
), nodes AS (
    SELECT key, 0 AS level, rank AS idx, leaf AS digest, n FROM ranked
    UNION ALL
    SELECT key, any_value(level) + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2
    FROM nodes WHERE n > 1 GROUP BY key, idx // 2
), subroots AS (
    SELECT key, level AS height, digest, row_number() OVER (ORDER BY encode(key)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, place AS idx, digest, n FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2
    FROM tops WHERE n > 1 GROUP BY idx // 2
), every AS (
    SELECT key, level, idx, digest FROM nodes WHERE n > 1
    UNION ALL
    SELECT s.key, s.height + t.level, t.idx, t.digest FROM subroots s, tops t WHERE t.n > 1
), paths AS (
    SELECT doc_id, r.key, rank, l.level, s.digest AS sibling, (CASE WHEN l.level < height THEN rank >> l.level ELSE place >> (l.level - height) END) % 2 = 1 AS at_left
    FROM ranked r JOIN subroots USING (key) JOIN (SELECT DISTINCT key, level FROM every) l ON l.key = r.key
    LEFT JOIN every s ON s.key = r.key AND s.level = l.level
     AND s.idx = xor(CASE WHEN l.level < height THEN rank >> l.level ELSE place >> (l.level - height) END, 1)
), proofs AS (
    SELECT key, rank, list(sibling ORDER BY level) AS siblings, list(at_left ORDER BY level) AS lefts FROM paths GROUP BY key, rank
), folds AS (
    SELECT key, rank, 1 AS k, altered AS node FROM ranked
    UNION ALL
    SELECT key, rank, k + 1, sha256(CASE WHEN siblings[k] IS NULL THEN node WHEN lefts[k] THEN siblings[k] || node ELSE node || siblings[k] END)
    FROM folds JOIN proofs USING (key, rank) WHERE k <= len(siblings)
)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(coalesce(array_to_string(siblings, ''), '')) AS proof_sha256,
       node AS folded_root, node = t.digest AS verified
FROM ranked r JOIN subroots s USING (key) JOIN tops t ON t.n = 1 LEFT JOIN proofs p USING (key, rank)
JOIN folds f ON f.key = r.key AND f.rank = r.rank AND f.k = coalesce(len(siblings), 0) + 1
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, and the error of all vectors of its label."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    found = vector_codes.compress(vectors, parts=16, entries=64, rounds=2, scale=256, keep=("label",))
    rows = kept(found.rows.select("row.id", "row.label", "code", "error"), "codes").withColumns(
        {"known": F.col("label").isNotNull(), "named": F.coalesce("label", F.lit(0))}
    )
    sums = rows.groupBy("known", "named").agg(F.try_sum("error").alias("label_error"))
    return lookup(rows, sums, ["known", "named"], spread="id").select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.books_sha256()).alias("codebooks_sha256")
    )


_ROUND = r"""
, apart{k} AS (
    SELECT p.r, p.pos, b.idx, list_sum(list_transform(list_zip(p.c, b.c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
    FROM parts p JOIN book{k} b USING (pos)
), near{k} AS (
    SELECT r, pos, min(d) AS d, arg_min(idx, d * 64 + idx) AS idx FROM apart{k} GROUP BY r, pos
)"""
_LLOYD = r"""
, means{k} AS (
    SELECT pos, idx, i, CAST(floor(sum(c[i]) / count(*)) AS BIGINT) AS m
    FROM near{k} JOIN parts USING (r, pos), unnest(range(1, len(c) + 1)) AS u(i) GROUP BY pos, idx, i
), book{n} AS (
    SELECT b.pos, b.idx, coalesce(m.c, b.c) AS c
    FROM book{k} b LEFT JOIN (SELECT pos, idx, list(m ORDER BY i) AS c FROM means{k} GROUP BY pos, idx) m USING (pos, idx)
)"""
ORACLE["op12_vector_codes"] = (
    r"""
WITH clean AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, vec_id, label, v
    FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS (
    SELECT r, pos, v[pos * len(v) // 16 + 1:(pos + 1) * len(v) // 16] AS c FROM clean, range(16) AS p(pos)
), book0 AS (
    SELECT pos, r AS idx, c FROM parts WHERE r < 64
)"""
    + "".join(_ROUND.format(k=k) + (_LLOYD.format(k=k, n=k + 1) if k < 2 else "") for k in range(3))
    + r"""
, coded AS (
    SELECT r, string_agg(printf('%02x', idx), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r
), books AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, idx)) AS books FROM book2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256
FROM clean JOIN coded USING (r), books
"""
)


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the record that is read back from its archive."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.read(warc.write(pages, min_bytes=0), payloads=False)

    def header(name: str) -> Column:
        return F.try_element_at("headers", F.lit(name.lower()))

    return records.filter("type IS NULL OR type <> 'warcinfo'").select(
        header(warc.PAGE_ID).cast("long").alias("page_id"),
        F.try_element_at("http_headers", F.lit("content-length")).cast("long").alias("payload_bytes"),
        F.regexp_replace(header("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"),
        header(warc.REFERS_TO).cast("long").alias("refers_to"),
        "error",
    )


_DIGITS = " || ".join(f"to_base(CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT), 32, 4)" for k in range(8))
ORACLE["op13_warc"] = f"""
WITH sized AS (
    SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY p ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY p) AS first FROM sized
)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
       translate({_DIGITS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to,
       CAST(NULL AS VARCHAR) AS error
FROM ranked
"""
