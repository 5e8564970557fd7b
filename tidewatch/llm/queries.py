"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    bpe,
    brown,
    credentials,
    divergence,
    languages,
    licenses,
    mixing,
    naming,
    pages,
    quality,
    resampling,
    simhash,
    spans,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query and, where SQL can express it, its twin."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Per-document counts, shared by the twins of the quality query and of the pipeline's first stage.
MEASURES_SQL = r"""
words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM {docs}
),
thirds AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM (
    SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS tri
    FROM words, unnest(generate_series(1, len(w) - 2)) AS t(i)
  )
),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM thirds, unnest([i, i + 1, i + 2]) AS u(p) WHERE n >= 2 GROUP BY doc_id
),
measured AS (
  SELECT words.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id)
),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
),
failures AS (
  SELECT source, rule, count(*) AS n, sum(bad::INT) AS f FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule,
           unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, n_symbols > n_words,
                   2 * n_dup_lines > n_lines]) AS bad
    FROM judged
  ) GROUP BY source, rule
),
priors AS (
  SELECT rule, sum(n) AS n, count(*) AS hosts, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS m,
         sum(f * f / n) AS q
  FROM failures GROUP BY rule
),
hosts AS (
  SELECT source, max((f + m * s) / (failures.n + s)) < 0.8 AS host_kept
  FROM failures JOIN (
    SELECT rule, m, least(greatest(
      m * (1 - m) / greatest((q - m * m * n) / n - m * (1 - m) * hosts / n, 1e-12) - 1, 1), 1e6) AS s
    FROM priors
  ) p USING (rule) GROUP BY source
)
"""

OP9_SQL = (
    "WITH "
    + MEASURES_SQL.format(docs="documents")
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_kept AS kept
FROM judged JOIN hosts ON judged.source IS NOT DISTINCT FROM hosts.source
"""
)


@register("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judged(documents(spark, sf_dir))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@register("op5_exact_dedup", OP5_SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.duplicates(documents(spark, sf_dir)).drop("_rid")


@register("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


OP6_SQL = rf"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
),
sources AS (
  SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS weight FROM (
    SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM sizes GROUP BY source
  )
),
levels AS (
  SELECT 0 AS step, sum(s)::DOUBLE / sum(weight) AS level FROM sources
  UNION ALL
  SELECT step + 1, (all_s - stopped_s)::DOUBLE / (all_w - stopped_w) FROM (
    SELECT step, sum(s) AS all_s, sum(weight) AS all_w, sum(CASE WHEN 3 * s <= level * weight THEN 3 * s ELSE 0 END) AS stopped_s,
           sum(CASE WHEN 3 * s <= level * weight THEN weight ELSE 0 END) AS stopped_w
    FROM levels CROSS JOIN sources GROUP BY step
  ) WHERE all_w > stopped_w AND step <= (SELECT count(*) FROM sources)
),
scale AS (
  SELECT *, sum(share) OVER (ORDER BY sid)::BIGINT AS upto FROM (
    SELECT *, CASE WHEN s > 0 THEN round(target / s * blocks * 1048576)::BIGINT ELSE 0 END AS share FROM (
      SELECT *, ceil(s / b)::BIGINT AS blocks FROM (
        SELECT *, least((3 * s)::DOUBLE, (SELECT arg_max(level, step) FROM levels) * weight) AS target,
               greatest(1, least({mixing.BLOCK}, ceil(s / {mixing.LEAST_BLOCKS})))::BIGINT AS b FROM sources
      )
    )
  )
),
points AS (
  SELECT slot, floor(((slot % 1048576) * {mixing._GOLDEN!r}::DOUBLE
    + ((slot // 1048576) * {(mixing._UNIT * mixing._GOLDEN) % 1.0!r}::DOUBLE) % 1.0::DOUBLE) % 1.0::DOUBLE * whole)::BIGINT AS place
  FROM (SELECT max(upto) AS whole FROM scale), unnest(generate_series(0, (whole + 1048575) // 1048576 - 1)) AS t(slot)
),
slots AS (
  SELECT sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS nth
  FROM points JOIN scale ON place >= upto - share AND place < upto
),
times AS (SELECT sid, nth % blocks AS no, count(*) AS n FROM slots WHERE nth // blocks < 3 GROUP BY ALL),
placed AS (
  SELECT doc_id, sid, b, size, sum(size) OVER (PARTITION BY sid ORDER BY md5(doc_id::VARCHAR), doc_id)::BIGINT AS e
  FROM sizes JOIN scale ON sizes.source IS NOT DISTINCT FROM scale.source WHERE size > 0
),
pieces AS (
  SELECT doc_id, sid, no, least(e, (no + 1) * b) - greatest(e - size, no * b) AS words
  FROM placed, unnest(generate_series((e - size) // b, (e - 1) // b)) AS t(no)
),
taken AS (SELECT doc_id, sum(words * n)::BIGINT AS taken FROM pieces JOIN times USING (sid, no) GROUP BY doc_id)
SELECT sizes.doc_id, size, s AS source_size, target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM sizes JOIN scale ON sizes.source IS NOT DISTINCT FROM scale.source LEFT JOIN taken USING (doc_id)
"""


@register("op6_mix_sources", OP6_SQL)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).drop("_rid")


@register("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    known = languages.prototypes(docs.where(~held_out))
    return languages.identify(docs, known).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


@register("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


@register("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_max("matches.coverage").alias("best_coverage"),
        F.array_min("matches.start").alias("first_word"),
    )


@register("op7_language_model_scores")
def op7_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return brown.scores(docs, held_out).drop("_rid")


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS body
  FROM words, unnest(generate_series(1, len(w) - 12)) AS t(i)
),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY body) AS first FROM windows) WHERE first < doc_id
),
covered AS (
  SELECT DISTINCT doc_id, p FROM repeated, unnest(generate_series(i, i + 12)) AS t(p)
),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM (
    SELECT doc_id, p, w[p] AS word FROM words, unnest(generate_series(1, len(w))) AS t(p)
  ) ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
),
removed AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(removed.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.body, '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@register("op8_substring_dedup", OP8_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spans.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x60\x7B-\x7F]+') AS w
  FROM documents
),
cells AS (
  SELECT lang, source, doc, term, count(*) AS c FROM docs, unnest(w) AS t(term) GROUP BY ALL
),
kept AS (SELECT lang, term FROM cells GROUP BY lang, term HAVING count(*) >= 30),
counts AS (
  SELECT lang, source, term, sum(c)::HUGEINT AS c FROM cells SEMI JOIN kept USING (lang, term) GROUP BY ALL
),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
totals AS (
  SELECT groups.lang, groups.source, coalesce(sum(c), 0)::HUGEINT + 5 * any_value(v) AS d
  FROM groups JOIN sizes USING (lang) LEFT JOIN counts ON counts.lang = groups.lang AND counts.source = groups.source
  GROUP BY ALL
),
shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 5)::HUGEINT) // d AS p
  FROM totals JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
),
wholes AS (
  SELECT lang, term, 1 + (1000000000 * (sum(c) + 5)::HUGEINT) // (any_value(n) + 5 * any_value(v)) AS q
  FROM counts JOIN (SELECT lang, sum(c)::HUGEINT AS n FROM counts GROUP BY lang) USING (lang) JOIN sizes USING (lang)
  GROUP BY lang, term
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(f), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN wholes USING (lang, term) WHERE c > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
) WHERE part = 'pair' OR rank <= 50
"""


@register("op11_source_divergence", OP11_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(documents(spark, sf_dir))


#: The check sum of a word: its bytes are folded into a state by a table of 256 entries.
OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) AS t(i)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(v ORDER BY b) AS entry FROM steps WHERE k = 8),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
aims AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
),
uses AS (SELECT doc_id, word, count(*) AS n FROM docs, unnest(w) AS t(word) GROUP BY ALL),
known AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM uses UNION ALL SELECT word FROM aims)),
states AS (
  SELECT word, h, 1 AS place, 4294967295::BIGINT AS state FROM known
  UNION ALL
  SELECT word, h, place + 2, xor(state >> 8, entry[(xor(state & 255, ('0x' || substr(h, place, 2))::BIGINT) + 1)::INT])
  FROM states, crc WHERE place < length(h)
),
buckets AS (SELECT word, xor(state, 4294967295) % 10000 AS bucket FROM states WHERE place > length(h)),
raw AS (SELECT bucket, sum(n) AS s FROM uses JOIN buckets USING (word) GROUP BY bucket),
aim AS (SELECT bucket, count(*) AS t FROM aims JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE)
                                 / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM raw LEFT JOIN aim USING (bucket),
       (SELECT coalesce(sum(s), 0) AS big_s FROM raw), (SELECT count(*) AS big_t FROM aims)
),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM uses JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT docs.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || docs.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                     / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)
),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@register("op12_importance_resampling", OP12_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resampled(documents(spark, sf_dir), target).drop("_rid", "n_words")


def _matches_sql(name: str, pattern: str, good: str = "true") -> str:
    """A table of a pattern's matches: doc, kind, s (start), e (end), from the pieces between them."""
    # Either case is spelled out: SQL's case folding would let in letters beyond ASCII.
    quoted = pattern.replace("'", "''")
    return f"""
{name} AS (
  SELECT doc, '{name}' AS kind, e - length(body) AS s, e FROM (
    SELECT doc, m[i] AS body, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc ORDER BY i)::BIGINT AS e
    FROM (SELECT doc, regexp_extract_all(text, '{quoted}') AS m, regexp_split_to_array(text, '{quoted}') AS g FROM docs),
         unnest(generate_series(1, len(m))) AS t(i)
  ) WHERE {good}
)"""


def _either_case(names: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names)


_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
_SPANS_SQL = ",".join(
    [
        _matches_sql(
            "assign",
            f"(?:{_either_case(credentials.SECRET_NAMES)}){_NAMED}[A-Za-z0-9+/_.=-]+",
            f"length(regexp_replace(body, '^(?:{_either_case(credentials.SECRET_NAMES)})"
            + _NAMED.replace("'", "''")
            + "', '')) >= 8",
        ),
        _matches_sql("access", "AKIA[A-Z0-9]+", "length(body) >= 16"),
        _matches_sql("hex", "[0-9a-f]+", "length(body) >= 32"),
        _matches_sql(
            "logins",
            f"(?:{_either_case(credentials.LOGIN_NAMES)}){_NAMED}[A-Za-z0-9+/_.@-]+",
            f"length(regexp_replace(body, '^(?:{_either_case(credentials.LOGIN_NAMES)})"
            + _NAMED.replace("'", "''")
            + "', '')) >= 3",
        ),
        _matches_sql("endpoint", credentials.ENDPOINT.pattern),
        _matches_sql(
            "runs",
            r"[A-Za-z0-9+/_=-]+",
            f"length(body) BETWEEN {credentials.BARE_LEAST} AND {credentials.BARE_MOST} AND regexp_matches(body, '[0-9]')"
            " AND regexp_matches(body, '[a-z]') AND regexp_matches(body, '[A-Z]')",
        ),
        _matches_sql("breaks", r"\n[\x20\x09\x0D]*\n"),
    ]
)


def _near_sql(other: str) -> str:
    """Whether a span x has a part of another table in its scope and within reach."""
    return f"""EXISTS (SELECT 1 FROM {other} y WHERE y.doc = x.doc AND y.scope = x.scope
      AND y.s <= x.e + {credentials.REACH} AND y.e >= x.s - {credentials.REACH})"""


_APART = "NOT EXISTS (SELECT 1 FROM {0} y WHERE y.doc = x.doc AND y.s < x.e AND y.e > x.s)"

OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
{_SPANS_SQL},
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
login AS (SELECT doc, 'login' AS kind, s, e FROM logins x WHERE {_APART.format("base")}),
strong AS (SELECT * FROM base UNION ALL SELECT * FROM login UNION ALL SELECT * FROM endpoint),
parts AS (
  SELECT *, (SELECT count(*) FROM breaks b WHERE b.doc = p.doc AND b.s < p.s) AS scope FROM (
    SELECT * FROM strong UNION ALL SELECT doc, 'bare', s, e FROM runs x WHERE {_APART.format("strong")}
  ) p
),
ids AS (SELECT * FROM parts WHERE kind = 'access'),
names AS (SELECT * FROM parts WHERE kind = 'login'),
places AS (SELECT * FROM parts WHERE kind = 'endpoint'),
bare AS (
  SELECT * FROM parts x WHERE kind = 'bare' AND ({_near_sql("ids")} OR ({_near_sql("names")} AND {_near_sql("places")}))
),
secrets AS (SELECT * FROM parts WHERE kind IN ('assign', 'hex') UNION ALL SELECT * FROM bare),
reported AS (
  SELECT * FROM secrets UNION ALL SELECT * FROM ids
  UNION ALL SELECT * FROM parts x WHERE kind IN ('login', 'endpoint') AND {_near_sql("secrets")}
),
listed AS (
  SELECT doc, kind, s, list_position(['assign', 'access', 'hex', 'login', 'endpoint', 'bare'], kind) AS k,
         kind || ':' || s || ':' || e AS span FROM reported
),
found AS (
  SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, k) FILTER (k <= 3) AS base,
         string_agg(span, ',' ORDER BY s, k) AS spans
  FROM listed GROUP BY doc
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (doc)
"""


@register("op13_secret_scan", OP13_SQL)
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in credentials.BASE],
        F.sha2(credentials.named(F.col("spans"), credentials.BASE), 256).alias("base_sha256"),
        credentials.named(F.col("spans")).alias("spans"),
    )
