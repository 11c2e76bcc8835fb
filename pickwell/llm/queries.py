"""The queries of this subpackage, each over a whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.llm import byte_bpe, conversation_repair, exact_dedup, html_text, jaccard_join, language_id, lexical_search, packing, secret_scan, suffix_dedup, token_files, topk_search, toxicity
from pickwell.llm.common import fold, read
from pickwell.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


TOXIC_AT = 0.7


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model that learns from the labels of the other folds."""
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted")
    )


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; of each the largest id stays."""
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="max")


ORACLES["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text to ids and back."""
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles are alike by 0.8 or more."""
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger starts empty, so that every blob of the table is scanned."""
    docs, ledger = read(spark, sf_dir, "documents"), fresh_path(spark, "secret-ledger")
    secret_scan.scan_unseen(docs, ledger)
    return secret_scan.report(secret_scan.findings(docs, ledger))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 ids."""
    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    return packing.pack(packing.cut(read(spark, sf_dir, "documents"), tokenizer))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the other folds."""
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    texts = language_id.training_texts(docs, ~held_out)
    return language_id.predict(docs, texts).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that no 200-byte string found elsewhere covers."""
    left = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), keep="none")
    return left.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every twentieth."""
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLES["op9_topk_search"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score FROM scores
)
SELECT * FROM ranked WHERE rank <= 20
"""


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as files of token ids and read back from them."""
    path = fresh_path(spark, "token-files")
    token_files.write(read(spark, sf_dir, "documents"), Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), path)
    return token_files.documents(spark, path)


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = r"""
WITH lowered AS (
    SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
    UNION ALL
    SELECT 'i', item_id, 0,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark
), docs AS (SELECT row, id AS doc_id, CAST(len(terms) AS BIGINT) AS n FROM lowered WHERE side = 'd' AND len(terms) > 0),
stats AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM docs),
sized AS (SELECT row, doc_id, 75 + (25 * n * big_n) // big_l AS m FROM docs, stats),
postings AS (
    SELECT row, term, CAST(count(*) AS BIGINT) AS tf
    FROM (SELECT row, unnest(terms) AS term FROM lowered WHERE side = 'd') GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM postings, stats GROUP BY term, big_n
), asked AS (
    SELECT id AS item_id, term, CAST(count(*) AS BIGINT) AS repeats
    FROM (SELECT id, unnest(terms) AS term FROM lowered WHERE side = 'i') GROUP BY ALL
), scores AS (
    SELECT item_id, row, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (row) GROUP BY item_id, row, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    conversations = read(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversations, conversation_repair.damaged(conversations))


def _best_edits() -> str:
    """SQL of a step from the end: ``k`` has the cost (12 digits) and edits of the rest for start, system, user and assistant;
    ``t`` the initial and fault of the turn before it."""
    put = lambda k, cost, letter: f"printf('%012d', CAST({k}[1:12] AS BIGINT) + {cost}) || '{letter}' || {k}[13:]"
    mend = "CASE t[2] WHEN 'truncated' THEN 3 ELSE 0 END"
    stays = "t[2] NOT IN ('blank', 'duplicate')"

    def turn(state: int, wanted: str, to: dict[str, int]) -> str:
        keep = " ".join(f"WHEN {stays} AND t[1] = '{role}' THEN {put(f'k[{at}]', mend, 'K')}" for role, at in to.items())
        rename = f"CASE WHEN {stays} THEN {put(f'k[{to[wanted]}]', f'3 + {mend}', 'R')} ELSE '~' END"
        return f"least({put(f'k[{state}]', 4, 'D')}, {rename}, CASE {keep} ELSE '~' END)"

    raw = ", ".join([turn(1, "u", {"s": 2, "u": 3}), turn(2, "u", {"u": 3}), turn(3, "a", {"a": 4}), turn(4, "u", {"u": 3})])
    user = f"least(r[3], {put('r[4]', 3, 'I')})"
    inserted = f"[r[1], r[2], {user}, least(r[4], {put('r[3]', 3, 'I')})]"
    led = f"[least(u[1], {put('u[3]', 3, 'I')}), least(u[2], {put('u[3]', 3, 'I')}), u[3], u[4]]"
    return f"list_transform(list_transform([[{raw}]], lambda r: {inserted}), lambda u: {led})[1]"


ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE bits AS (
    SELECT n, n AS v, 0 AS k FROM (SELECT unnest(range(256)) AS n)
    UNION ALL SELECT n, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY n) AS steps FROM bits WHERE k = 8),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                          lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
    FROM conversations
), dealt AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce(list_prepend(4294967295, bytes), lambda acc, b: xor(acc >> 8, steps[(xor(acc, b) & 255) + 1])), 4294967295) % 20 AS what
    FROM keyed, crc
), damaged AS (
    SELECT conv_id, turn, CASE what WHEN 4 THEN 'user' ELSE role END AS role,
           CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM dealt, (SELECT unnest([1, 2]) AS copy) WHERE what <> 0 AND (copy = 1 OR what = 3)
), turns AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS nr,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth,
           CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial
    FROM damaged
), faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE 'ok' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY nr) || initial AS pair
    FROM turns
), whole AS (
    SELECT conv_id, list([initial, fault] ORDER BY nr DESC) AS signature,
           CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), solved AS (
    SELECT conv_id, gaps, blank, duplicate, truncated, illegal,
           list_reduce(list_prepend(['000000000000', '000000000006II', '000000000003I', '000000000000'], signature),
                       lambda k, t: {_best_edits()})[1] AS best
    FROM whole
), audited AS (SELECT *, CAST(best[1:12] AS BIGINT) AS cost, best[13:] AS audit FROM solved),
letters AS (
    SELECT conv_id, pos, audit[pos] AS letter FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS pos FROM audited)
), placed AS (
    SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS nr,
           count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS place
    FROM letters
), kept AS (
    SELECT p.conv_id, p.pos, p.place, CASE WHEN p.letter = 'K' THEN f.role END AS role,
           CASE WHEN p.letter = 'I' THEN '' ELSE f.text END AS text,
           max(CASE WHEN p.place = 1 AND p.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led
    FROM placed AS p LEFT JOIN faulty AS f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.nr = p.nr AND p.letter <> 'I'
    WHERE p.letter <> 'D'
), texts AS (
    SELECT conv_id, string_agg(coalesce(role, CASE (place - led) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS text
    FROM kept GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN audited AS a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts AS t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
