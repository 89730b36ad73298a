"""Queries over ``documents``, ``labels``, ``benchmark`` and ``pages`` and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text, vectors
from colloquy.operators import memory, retrieval, sampling, speech
from colloquy.plans import read

TERMINAL = r"""[.!?…"“”]\s*$"""
SEPARATOR = r"^\s*([-=*_])[-=*_]{2,}\s*$"
LICENCE = r"^\s*Licensed "
LEXICON = {"angry": ("idiot", "scum", "moron"), "sad": ("pathetic", "worthless", "loser"), "happy": ("the", "der", "el")}
ORDER = ("angry", "sad", "happy")
SYMBOLS = "abcdefghijklmnopqrstuvwxyz"
BOUNDS = (32, 300, 400, 500, 600, 700, 800, 900, 1000)


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", *columns)


def speaker_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.holdout_by_group(_docs(spark, sf_dir, "source"), group="source", ids=("doc_id",), per_group=3, total=40, seed="7")


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.dense_ids(_docs(spark, sf_dir, "source"), "source", "doc_id")


def first_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _docs(spark, sf_dir, "text").select("doc_id", text.normal_key(F.col("text")).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


def anti_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "lang").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "text")
    good = F.filter(text.lines(F.col("text")), lambda x: x.rlike(TERMINAL) & ~x.rlike(SEPARATOR) & ~x.rlike(LICENCE))
    return docs.select("doc_id", F.size(good).cast("long").alias("n_kept"), F.md5(F.array_join(good, "\n")).alias("text_md5"))


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _docs(spark, sf_dir, "text").select(
        "doc_id", c.rlike("[가-힣]").alias("has_hangul"), c.rlike("[ぁ-んァ-ヶ一-龯]").alias("has_kana"), c.rlike(r"[\[\]{}()]").alias("has_brackets"),
        text.balanced_quotes(c).alias("balanced"), text.keyword_any(c, ("idiot", "Licensed")).alias("keyword"), (~text.strip(c).rlike(TERMINAL)).alias("unfinished"),
        text.rough_tokens(c).cast("long").alias("n_tokens"),
    )


def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    rules = [
        ("short", F.length(c) < 60), ("licence", c.contains("Licensed")), ("brackets", c.rlike(r"[\[\]{}]")), ("quotes", ~text.balanced_quotes(c)),
        ("digits", F.regexp_count(c, F.lit("[0-9]")) > 5), ("stars", c.contains("***")), ("one line", ~c.contains("\n")), ("open end", ~text.strip(c).rlike(TERMINAL)),
    ]
    return _docs(spark, sf_dir, "text").select("doc_id", text.first_failure(rules, "ok").alias("code"))


def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.token_set(F.col("text"))
    return _docs(spark, sf_dir, "text").select("doc_id", F.size(words).cast("long").alias("n_words"), F.md5(F.array_join(F.array_sort(words), " ")).alias("words_md5"))


def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a tenth or more of a benchmark item's 8-word runs, by a join on the run."""
    n = 8
    items = read(spark, sf_dir, "benchmark").select("item_id", vectors.word_ngrams(text.words(F.col("text")), n).alias("grams")).filter("size(grams) > 0")
    wanted = items.select("item_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    docs = _docs(spark, sf_dir, "text").select("doc_id", F.explode(vectors.word_ngrams(text.words(F.col("text")), n)).alias("gram"))
    hits = docs.join(wanted, "gram").groupBy("item_id", "doc_id").agg((F.count("*") / F.max("n")).alias("overlap"))
    return hits.filter("overlap >= 0.1").select("item_id", "doc_id", F.round("overlap", 9).alias("overlap"))


def keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.lower("text")
    hits = {k: text.keyword_hits(c, v) for k, v in LEXICON.items()}
    return _docs(spark, sf_dir, "text").select(
        "doc_id", text.keyword_class(c, LEXICON, ORDER, "neutral").alias("label"), text.one_hot_label(hits, ORDER, "neutral").alias("first_label")
    )


def lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred documents of each source as slots, ranked for the words of the source's first document."""
    docs = _docs(spark, sf_dir, "source", "text").select("doc_id", "source", text.token_set(F.col("text")).alias("words"))
    newest = retrieval.top_k(docs, 100, F.col("doc_id").desc(), query="source", rank="_n").drop("_n")
    asked = docs.groupBy("source").agg(F.min_by("words", "doc_id").alias("asked"))
    scored = newest.join(asked, "source").withColumn("score", F.round(retrieval.lexical_score(F.pmod("doc_id", F.lit(10)) / 10, F.col("asked"), F.col("words")), 9))
    return retrieval.top_k(scored.select("source", "doc_id", "score"), 8, F.col("score").desc(), F.col("doc_id").desc(), query="source")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    items = _docs(spark, sf_dir, "text").select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text"))
    scored = retrieval.bm25(queries, items, k=5, digits=6).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, 5, F.col("score").desc(), F.col("item_id")).select("query_id", "item_id", "score", "rank")


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "n_chars").withColumn("bucket", sampling.length_buckets(F.col("n_chars"), BOUNDS))
    return sampling.padded_buckets(docs, "bucket", multiple=2 * 8)


def bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "n_chars").withColumn("bucket", sampling.length_buckets(F.col("n_chars"), BOUNDS))
    dealt = sampling.bucket_batches(docs, "bucket", "doc_id", replicas=2, batch=8)
    return dealt.groupBy("bucket", "replica").agg(F.count("*").alias("n"), F.max("step").alias("last_step"), F.countDistinct("doc_id").alias("n_docs"))


def even_distribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "n_chars").withColumn("parts", F.pmod("doc_id", F.lit(7)) + 1)
    each = docs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return each.select("doc_id", "part", vectors.even_share(F.col("n_chars"), F.col("parts"), F.col("part")).alias("share"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.regexp_replace("text", r"\s+", " ")
    return _docs(spark, sf_dir, "text").select("doc_id", F.size(text.sentences(c)).cast("long").alias("n_sentences"), F.length(F.coalesce(F.get(text.sentences(c), F.lit(0)), F.lit(""))).cast("long").alias("first_chars"))


def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = speech.with_blanks(speech.symbol_ids(F.split(F.lower("text"), ""), SYMBOLS, unknown=len(SYMBOLS) + 1))
    return _docs(spark, sf_dir, "text").select("doc_id", F.size(ids).cast("long").alias("n_ids"), F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x).alias("id_sum"))


def dictionary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is in one of the dictionaries at least: in the first alone, in the second alone, or in both."""
    docs = _docs(spark, sf_dir, "lang", "source")
    a = docs.filter("doc_id % 3 <> 0").select("doc_id", F.col("lang").alias("word"))
    b = docs.filter("doc_id % 2 = 0 OR doc_id % 3 = 0").select("doc_id", F.col("source").alias("word"))
    return memory.merge_dictionaries(a, b, key="doc_id", value="word")


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keep_newest(_docs(spark, sf_dir, "source"), group="source", order="doc_id", keep=10)


def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = sampling.unit_interval(sampling.seeded("3", F.col("doc_id")))
    return _docs(spark, sf_dir).select("doc_id", sampling.weighted_choice(u, {"a": 0.5, "b": 0.3, "c": 0.2}).alias("choice"), sampling.bank_choice(sampling.seeded("4", F.col("doc_id")), ("x", "y", "z")).alias("bank"))


def transcript_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first lines as transcript lines, every ninth with a field too many, read back with error routing."""
    first = F.regexp_replace(F.substring_index("text", "\n", 1), r"[|\r]", " ")
    line = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("source"), F.upper("lang"), first)
    raw = _docs(spark, sf_dir, "text", "lang", "source").select(F.when(F.col("doc_id") % 9 == 0, F.concat(line, F.lit("|x"))).otherwise(line).alias("value"))
    parsed = speech.parse_transcript(raw)
    return parsed.groupBy("speaker", "language", "error").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def trainable_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction pairs from documents and their labels: a pair needs two texts that are not blank."""
    docs = _docs(spark, sf_dir, "text")
    pairs = docs.select("doc_id", text.strip(F.substring_index("text", "\n", 1)).alias("instruction"), text.strip(F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)")).alias("output"))
    return pairs.filter("instruction <> '' AND output <> ''").select("doc_id", F.md5("instruction").alias("instruction_md5"), F.md5("output").alias("output_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        speaker_holdout, dense_ids, first_dedup, anti_resume, line_filter, text_flags, first_failure, token_set, ngram_overlap, keyword_class, lexical_rank, bm25_topk, length_buckets,
        bucket_batches, even_distribute, sentence_split, symbol_ids, dictionary_merge, retention, weighted_choice, transcript_roundtrip, trainable_docs,
    )
}

_BUCKET = "CASE " + " ".join(f"WHEN n_chars > {a} AND n_chars <= {b} THEN {i}" for i, (a, b) in enumerate(zip(BOUNDS, BOUNDS[1:], strict=False))) + " END"
_HITS = {k: " + ".join(f"contains(lower(text), '{w}')::INT" for w in v) for k, v in LEXICON.items()}
_WORDS = "regexp_extract_all(lower({c}), '[가-힣A-Za-z0-9]+')"
_GRAMS = "CASE WHEN len(w) >= 8 THEN list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) ELSE [] END"
_TERMINAL_SQL = r"""[.!?…"“”]\s*$"""

ORACLE_SQL = {
    "speaker_holdout": """WITH r AS (SELECT doc_id, source, md5('7|' || doc_id) AS d, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) AS n FROM documents),
        h AS (SELECT doc_id, row_number() OVER (ORDER BY d, doc_id) AS g FROM r WHERE n <= 3)
        SELECT doc_id, source, CASE WHEN g <= 40 THEN 'val' ELSE 'train' END AS part FROM r LEFT JOIN h USING (doc_id)""",
    "dense_ids": "SELECT source, row_number() OVER (ORDER BY first_pos) - 1 AS id, n FROM (SELECT source, min(doc_id) AS first_pos, count(*) AS n FROM documents GROUP BY 1)",
    "first_dedup": r"SELECT md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1",
    "anti_resume": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "line_filter": rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(str_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND regexp_matches(x, '{_TERMINAL_SQL}')
        AND NOT regexp_matches(x, '^\s*([-=*_])[-=*_]{{2,}}\s*$') AND NOT regexp_matches(x, '^\s*Licensed ')) AS k FROM documents)
        SELECT doc_id, len(k) AS n_kept, md5(array_to_string(k, chr(10))) AS text_md5 FROM l""",
    "text_flags": rf"""SELECT doc_id, regexp_matches(text, '[가-힣]') AS has_hangul, regexp_matches(text, '[ぁ-んァ-ヶ一-龯]') AS has_kana, regexp_matches(text, '[\[\]{{}}()]') AS has_brackets,
        (length(text) - length(replace(text, '"', ''))) % 2 = 0 AS balanced, contains(text, 'idiot') OR contains(text, 'Licensed') AS keyword,
        NOT regexp_matches(trim(text, ' ' || chr(10) || chr(9)), '{_TERMINAL_SQL}') AS unfinished, len(regexp_extract_all(text, '[가-힣A-Za-z0-9]+|[^\s]')) AS n_tokens FROM documents""",
    "first_failure": rf"""SELECT doc_id, CASE WHEN length(text) < 60 THEN 'short' WHEN contains(text, 'Licensed') THEN 'licence' WHEN regexp_matches(text, '[\[\]{{}}]') THEN 'brackets'
        WHEN (length(text) - length(replace(text, '"', ''))) % 2 <> 0 THEN 'quotes' WHEN len(regexp_extract_all(text, '[0-9]')) > 5 THEN 'digits' WHEN contains(text, '***') THEN 'stars'
        WHEN NOT contains(text, chr(10)) THEN 'one line' WHEN NOT regexp_matches(trim(text, ' ' || chr(10) || chr(9)), '{_TERMINAL_SQL}') THEN 'open end' ELSE 'ok' END AS code FROM documents""",
    "token_set": """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9_]{2,}')) AS w FROM documents)
        SELECT doc_id, len(w) AS n_words, md5(array_to_string(list_sort(w), ' ')) AS words_md5 FROM t""",
    "ngram_overlap": f"""WITH i AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents),
        ig AS (SELECT item_id, {_GRAMS} AS g FROM i), dg AS (SELECT doc_id, unnest({_GRAMS}) AS gram FROM d),
        x AS (SELECT item_id, len(g) AS n, unnest(g) AS gram FROM ig)
        SELECT item_id, doc_id, round(count(*) / max(n), 9) AS overlap FROM dg JOIN x USING (gram) GROUP BY 1, 2 HAVING count(*) / max(n) >= 0.1""",
    "keyword_class": f"""WITH h AS (SELECT doc_id, {_HITS['angry']} AS a, {_HITS['sad']} AS s, {_HITS['happy']} AS h FROM documents)
        SELECT doc_id, CASE WHEN greatest(a, s, h) = 0 THEN 'neutral' WHEN a = greatest(a, s, h) THEN 'angry' WHEN s = greatest(a, s, h) THEN 'sad' ELSE 'happy' END AS label,
        CASE WHEN a > 0 THEN 'angry' WHEN s > 0 THEN 'sad' WHEN h > 0 THEN 'happy' ELSE 'neutral' END AS first_label FROM h""",
    "lexical_rank": """WITH d AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[가-힣A-Za-z0-9_]{2,}')) AS w FROM documents),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM d), q AS (SELECT source, arg_min(w, doc_id) AS a FROM d GROUP BY 1),
        s AS (SELECT source, doc_id, round(0.7 * ((doc_id % 10) / 10) + 0.3 * CASE WHEN len(a) = 0 THEN 0 ELSE least(1.0, len(list_intersect(a, w)) / greatest(1, len(a))) END, 9) AS score FROM n JOIN q USING (source) WHERE r <= 100),
        k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id DESC) AS rank FROM s) SELECT * FROM k WHERE rank <= 8""",
    "bm25_topk": f"""WITH i AS (SELECT doc_id AS item_id, {_WORDS.format(c='text')} AS w FROM documents), q AS (SELECT item_id AS query_id, unnest({_WORDS.format(c='text')}) AS word FROM benchmark),
        qt AS (SELECT query_id, word, count(*) AS times FROM q GROUP BY 1, 2), l AS (SELECT item_id, len(w) AS len FROM i), st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
        tf AS (SELECT item_id, word, count(*) AS tf FROM (SELECT item_id, unnest(w) AS word FROM i) GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
        raw AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), m AS (SELECT avg(idf) AS mean_idf FROM raw),
        idf AS (SELECT word, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf FROM raw, m),
        s AS (SELECT query_id, item_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM qt JOIN idf USING (word) JOIN tf USING (word) JOIN l USING (item_id), st GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 5""",
    "length_buckets": f"SELECT bucket, count(*) AS n, CAST(ceil(count(*) / 16) * 16 AS BIGINT) AS padded FROM (SELECT {_BUCKET} AS bucket FROM documents) WHERE bucket IS NOT NULL GROUP BY 1",
    "bucket_batches": f"""WITH b AS (SELECT doc_id, {_BUCKET} AS bucket FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('0|' || doc_id), doc_id) - 1 AS place0, count(*) OVER (PARTITION BY bucket) AS n FROM b WHERE bucket IS NOT NULL),
        p AS (SELECT bucket, doc_id, unnest(list_filter(list_transform(range(0, 17), lambda k: place0 + k * n), lambda x: x < ceil(n / 16) * 16)) AS place FROM r)
        SELECT bucket, place % 2 AS replica, count(*) AS n, max(place // 16) AS last_step, count(DISTINCT doc_id) AS n_docs FROM p GROUP BY 1, 2""",
    "even_distribute": "SELECT doc_id, part, n_chars // parts + (part < n_chars % parts)::INT AS share FROM (SELECT doc_id, n_chars, doc_id % 7 + 1 AS parts, unnest(range(0, doc_id % 7 + 1)) AS part FROM documents)",
    "sentence_split": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents),
        s AS (SELECT doc_id, list_filter(str_split(regexp_replace(c, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS p FROM t)
        SELECT doc_id, len(p) AS n_sentences, length(coalesce(p[1], '')) AS first_chars FROM s""",
    "symbol_ids": """WITH t AS (SELECT doc_id, list_filter(str_split(lower(text), ''), lambda x: x <> '') AS c FROM documents),
        i AS (SELECT doc_id, list_transform(c, lambda x: CASE WHEN instr('abcdefghijklmnopqrstuvwxyz', x) > 0 THEN instr('abcdefghijklmnopqrstuvwxyz', x) ELSE 27 END) AS ids FROM t)
        SELECT doc_id, 2 * len(ids) + 1 AS n_ids, coalesce(list_sum(ids), 0) AS id_sum FROM i""",
    "dictionary_merge": """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.source, a.lang) AS word FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0) a
        FULL OUTER JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0) b ON a.doc_id = b.doc_id""",
    "retention": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n > 10",
    "weighted_choice": """WITH u AS (SELECT doc_id, ('0x' || substr(md5('3|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, ('0x' || substr(md5('4|' || doc_id), 1, 8))::BIGINT AS b FROM documents)
        SELECT doc_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS choice, ['x', 'y', 'z'][b % 3 + 1] AS bank FROM u""",
    "transcript_roundtrip": r"""WITH t AS (SELECT doc_id, source, upper(lang) AS language, regexp_replace(split_part(text, chr(10), 1), '[|\r]', ' ', 'g') AS text FROM documents)
        SELECT CASE WHEN doc_id % 9 <> 0 THEN source END AS speaker, CASE WHEN doc_id % 9 <> 0 THEN language END AS language, CASE WHEN doc_id % 9 = 0 THEN '5 fields' END AS error,
        count(*) AS n, sum(CASE WHEN doc_id % 9 <> 0 THEN length(text) END) AS n_chars FROM t GROUP BY 1, 2, 3""",
    "trainable_docs": """WITH p AS (SELECT doc_id, trim(split_part(text, chr(10), 1), ' ' || chr(9)) AS a, trim(substr(text, length(split_part(text, chr(10), 1)) + 1), ' ' || chr(10) || chr(9)) AS b FROM documents)
        SELECT doc_id, md5(a) AS instruction_md5, md5(b) AS output_md5 FROM p WHERE a <> '' AND b <> ''""",
}
