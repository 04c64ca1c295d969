"""Registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.backoff import score_documents
from pagemill.llm.common import documents
from pagemill.llm.exact_dedup import exact_duplicates
from pagemill.llm.fingerprints import compare_edited
from pagemill.llm.jaccard_join import near_duplicates
from pagemill.llm.language import identify
from pagemill.llm.line_dedup import line_report
from pagemill.llm.mixing import mixing_rates
from pagemill.llm.packing import pack
from pagemill.llm.pii import personal_data
from pagemill.llm.quality import quality
from pagemill.llm.spelling import variants
from pagemill.llm.toxicity import toxicity
from pagemill.llm.vector_codes import compress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op4_exact_dedup",
    f"""SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
        doc_id = max(doc_id) OVER w AS kept, sha256({NORM}) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY {NORM})""",
)
def _(spark, sf):
    return exact_duplicates(documents(spark, sf))


@query("op9_packing")
def _(spark, sf):
    return pack(documents(spark, sf))


@query("op1_language")
def _(spark, sf):
    return identify(documents(spark, sf))


@query("op6_toxicity")
def _(spark, sf):
    return toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query("op3_quality")
def _(spark, sf):
    return quality(documents(spark, sf))


@query("op7_fingerprints")
def _(spark, sf):
    return compare_edited(documents(spark, sf))


@query("op5_jaccard_join")
def _(spark, sf):
    return near_duplicates(documents(spark, sf)).drop("uid")


@query("op10_mixing")
def _(spark, sf):
    return mixing_rates(documents(spark, sf))


@query("op2_pii")
def _(spark, sf):
    return personal_data(documents(spark, sf))


@query("op8_katz_backoff")
def _(spark, sf):
    return score_documents(documents(spark, sf))


def _nearest_sql(books: str) -> str:
    """Nearest entry of every part, by plain squared distances."""
    return f"""SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT x.id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d
        FROM xs x JOIN {books} b USING (part, place) GROUP BY ALL) GROUP BY id, part"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, embedding
        FROM embeddings WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false))""",
        f"""xs AS MATERIALIZED (SELECT id, (i - 1) // w AS part, (i - 1) % w AS place, floor(4096 * x::DOUBLE)::HUGEINT AS v
        FROM (SELECT id, len(embedding) // {parts} AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM kept))""",
        f"b0 AS MATERIALIZED (SELECT id - 1 AS entry, part, place, v FROM xs WHERE id <= {entries})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({_nearest_sql(f'b{r}')})")
        steps.append(
            f"""m{r} AS MATERIALIZED (SELECT a.entry, x.part, x.place, sum(x.v) AS s, count(*)::HUGEINT AS c
            FROM xs x JOIN a{r} a USING (id, part) GROUP BY ALL)"""
        )
        steps.append(
            f"""b{r + 1} AS MATERIALIZED (SELECT b.entry, b.part, b.place,
            CASE WHEN c IS NULL THEN b.v ELSE (s - ((s % c) + c) % c) // c END AS v
            FROM b{r} b LEFT JOIN m{r} USING (entry, part, place))"""
        )
    steps.append(f"z AS MATERIALIZED ({_nearest_sql(f'b{rounds}')})")
    steps.append(
        """codes AS (SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM z GROUP BY id)"""
    )
    return f"""WITH {", ".join(steps)}
        SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error,
        (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
        FROM kept k JOIN codes c USING (id)"""


@query("op11_vector_codes", _codes_sql())
def _(spark, sf):
    return compress(spark.read.parquet(f"{sf}/embeddings.parquet"))


# crc32 with its public polynomial, a bit at a time
_CRC_SQL = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8],
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295::BIGINT), 4294967295::BIGINT)"""


@query(
    "op12_spelling",
    f"""WITH RECURSIVE runs AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    counted AS (SELECT run, n, length(run) AS l, coalesce(doc_id::VARCHAR, '') || ':' || run AS t
        FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL)),
    hashed AS MATERIALIZED (SELECT run, n, l, {_CRC_SQL} AS h FROM counted WHERE l >= 7),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN run[:(h % l)::INT] || run[(h % l)::INT + 2:] ELSE run END AS word, n FROM hashed)
        WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    cut AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM
        (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    one_way AS (SELECT DISTINCT c.word AS a, c.n AS a_n, w.word AS b, w.n AS b_n FROM cut c JOIN words w ON c.rest = w.word),
    pairs AS (SELECT a AS word, b AS near, b_n AS near_n FROM one_way UNION ALL SELECT b, a, a_n FROM one_way
        UNION ALL SELECT DISTINCT x.word, y.word, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
    best AS (SELECT word, count(*) AS n_near, min((-near_n, encode(near), near)) AS m FROM pairs GROUP BY word),
    forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -m[1] >= 10 * w.n THEN m[3] END AS form, CASE WHEN -m[1] >= 10 * w.n THEN -m[1] END AS form_n
        FROM words w LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS at, form AS up FROM forms
        UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.up = f.word)
    SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.up IS NULL""",
)
def _(spark, sf):
    return variants(documents(spark, sf), damage=31)


@query(
    "op13_line_dedup",
    """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS MATERIALIZED (SELECT uid, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT uid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d)),
    common AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT uid) >= 10),
    kept AS (SELECT uid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text
        FROM l WHERE k NOT IN (SELECT k FROM common) GROUP BY uid)
    SELECT doc_id, len(ls)::BIGINT AS n_lines, len(ls) - coalesce(n, 0) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (uid)""",
)
def _(spark, sf):
    return line_report(documents(spark, sf))
