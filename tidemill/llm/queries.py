"""The queries of this package and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Words of a text in DuckDB, as the operators take them.
WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


OP8_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
win AS (SELECT doc_id, s, list_slice(ws, s, s + 12) AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(s)),
first AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, s FROM win JOIN first USING (k) WHERE lo < doc_id), unnest(range(s, s + 13)) AS u(p)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
         list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


@query("op8_substring_dedup", OP8_SQL)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that start in an earlier document are removed."""
    from .substring_dedup import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf_dir, "documents")))


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingles have a Jaccard similarity of 0.75 or more."""
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_token_matrices")
def op7_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 4096 token ids, by checksum."""
    from .matrices import digest, packed_rows

    return digest(packed_rows(table(spark, sf_dir, "documents")))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 token ids."""
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item and the overlap."""
    from .decontamination import halves, leaks

    return leaks(table(spark, sf_dir, "documents"), halves(table(spark, sf_dir, "benchmark")))


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text under context-tree weighting, beside a unigram base."""
    from .lm_scoring import score

    return score(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned by weak supervision."""
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict of base rules and robust outlier distances."""
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


# The rules of the query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

OP6_SQL = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, strpos(url, '://') AS begin, url FROM pages),
r AS (SELECT page_id, CASE WHEN begin > 0 THEN substr(url, begin + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.*, rhost || rpath AS rule, verdict FROM p LEFT JOIN rules
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""


@query("op6_url_filters", OP6_SQL)
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by nested host and path rules."""
    from .url_filters import judge

    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(str(r) for r in URL_RULES)} AS rules(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages"), rules)


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies meet in every document, and how common their pairs are."""
    from .alignment import scores

    return scores(table(spark, sf_dir, "documents"))


@query("op13_vector_packing")
def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids under limits on ids, segments and loss-bearing ids."""
    from .vector_packing import pack

    return pack(table(spark, sf_dir, "documents")).drop("loss_tokens")


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(list_slice(ws, s, s + k - 1), ' ') AS phrase, count(*) AS f
  FROM w, unnest(range(1, 6)) AS t(k), unnest(range(1, len(ws) - k + 2)) AS u(s)
  GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
cuts AS (
  SELECT c.*, j, array_to_string(list_slice(ws, 1, j), ' ') AS p1, array_to_string(list_slice(ws, j + 1, k), ' ') AS p2
  FROM c, unnest(range(1, k)) AS t(j)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, l.f AS l, r.f AS r, n, j, (CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts JOIN g AS l ON l.lang = cuts.lang AND l.phrase = p1 JOIN g AS r ON r.lang = cuts.lang AND r.phrase = p2 JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (
  SELECT lang, array_to_string(list_slice(ws, s, s + m - 1), ' ') AS phrase, max(a) AS f
  FROM c, unnest(range(2, k)) AS t(m), unnest(range(1, k - m + 2)) AS u(s) GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
WHERE longer.f IS NULL OR 100 * longer.f < 100 * a
QUALIFY rank <= 2000
"""


@query("op12_phrase_mining", OP12_SQL)
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to five words that occur 100 times or more, by how far above chance they are."""
    from .phrases import phrases

    return phrases(table(spark, sf_dir, "documents"))
