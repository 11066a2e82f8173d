"""Operators that need sequences or difflib: Arrow UDFs and grouped maps over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import align, checks, prose
from quillspark.operators import editions, joins, spelling, structure, tables
from quillspark.plans import frames
from quillspark.plans.dialect import DUCK, SPARK, blocks, lines, operator, pairs, run_sql, with_
from quillspark.plans.registry import query
from quillspark.sources import books, epub
from quillspark.streaming import queue
from quillspark.tables import table


#: Arrow types of what a function of texts gives, and how many of a batch's values are Python objects at a time.
_TYPES = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_AT_ONCE = 256


def _by_parts(kind: str, function, *columns: pa.Array) -> pa.Array:
    """A function of columns' values, null where one of them is, a part of the rows after another: a batch's texts are not Python objects all at once."""
    parts = []
    for at in range(0, len(columns[0]), _AT_ONCE):
        rows = zip(*(c.slice(at, _AT_ONCE).to_pylist() for c in columns))
        parts.append(pa.array([None if any(v is None for v in row) else function(*row) for row in rows], _TYPES[kind]))
    return pa.concat_arrays(parts) if parts else pa.array([], _TYPES[kind])


def _column(kind: str, function):
    """A function of one text as an Arrow UDF; null in, null out."""

    @F.arrow_udf(kind)
    def udf(x: pa.Array) -> pa.Array:
        return _by_parts(kind, function, x)

    return udf


def _two(kind: str, function):
    @F.arrow_udf(kind)
    def udf(x: pa.Array, y: pa.Array) -> pa.Array:
        return _by_parts(kind, function, x, y)

    return udf


def _record(fields: str, function):
    """A function of texts (null if one of them is) that gives several fields, as a pandas UDF."""
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(fields)
    def udf(*columns: pd.Series) -> pd.DataFrame:
        rows = [(None,) * len(names) if any(v is None for v in row) else function(*row) for row in zip(*columns)]
        return pd.DataFrame(rows, columns=names)

    return udf


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, with_(pairs(SPARK)) + "SELECT * FROM pairs")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, with_(blocks(SPARK)) + "SELECT * FROM blocks")


@query("aln_01_edition_compare")
def edition_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines against another edition of it: lines dropped and added to by number, and a passage that only the copy has."""
    own = _blocks(spark, sf_dir).withColumnRenamed("doc_id", "book")
    more = F.when(F.col("ord") % 6 == 5, F.concat("text", F.lit(" inserted words here"))).when(F.col("ord") == 4, F.concat("text", F.lit("\n" + "only the other edition has this " * 8))).otherwise(F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", more.alias("text")))), lambda s: s.text)
    copies = own.where("ord % 7 != 3").groupBy("book").agg(F.array_join(lines, "\n").alias("text"))
    found = editions.compare_editions(own, copies)
    shown = F.array_join(F.transform("changes", lambda c: F.concat_ws("/", c.kind, c.ours, c.theirs, c.before)), "|")
    return found.select(F.col("book").alias("doc_id"), "place", "id", "outcome", "total", "words", "before", F.sha2(shown, 256).alias("sha"))


@query("aln_02_words")
def nfkc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _column("array<string>", align.words)("text").alias("words")).select("doc_id", F.size("words").cast("long").alias("n"), F.sha2(F.array_join("words", " "), 256).alias("sha"))


@query("aln_05_reader_agreement")
def reader_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a page agree if 0.85 of their words do, and the second is no refusal."""
    ratio = _two("double", lambda a, b: round(align.ratio(align.plain_words(a), align.plain_words(b)), 3))
    refusing = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("I'm sorry, but "), F.col("src"))).when(F.col("conv_id") % 5 == 1, F.col("src")).otherwise(F.col("out"))
    read = _pairs(spark, sf_dir).withColumn("out", refusing)
    found = read.select("conv_id", "turn", ratio("src", "out").alias("agreement"), checks.refused(F.col("out"), F.col("src")).alias("refused"))
    return found.withColumn("ok", (F.col("agreement") >= 0.85) & ~F.col("refused"))


@query("aln_06_combine_readers")
def combine_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.regexp_replace("text", "f", "ph")
    return _blocks(spark, sf_dir).select("doc_id", "ord", _two("string", align.combine)("text", other).alias("combined"))


@query("aln_07_skeleton")
def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words first, so that each is folded once."""
    words = run_sql(spark, sf_dir, "SELECT DISTINCT explode(regexp_extract_all(lower(text), '[a-zß-öø-ÿ]+', 0)) AS word FROM documents")
    return words.select("word", spelling.skeleton(F.col("word")).alias("skeleton"))


@query("aln_10_repetition_cut")
def repetition_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _column("string", align.cut_repetition)("text").alias("text")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@query("blk_09_emphasis")
def emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    styled = _column("string", lambda t: prose.emphasis([(w + " ", k % 5 == 0, k % 7 == 0) for k, w in enumerate(t.split(" "))]))
    return _blocks(spark, sf_dir).select("doc_id", "ord", styled("text").alias("markdown"))


@query("s_09_mask")
def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit("*"), F.regexp_replace("text", r"\*", ""), F.lit("*"))
    marked = F.when(F.col("ord") % 6 == 5, whole).otherwise(F.regexp_replace(F.regexp_replace("text", "(the) ", "*$1* "), "(was|und|que) ", "[$1](http://example.org/$1_(x)) "))
    masked = _column("string", lambda t: "\x1f".join([prose.mask(t)[0], *prose.mask(t)[1]]))
    found = _blocks(spark, sf_dir).select("doc_id", "ord", F.split(masked(marked), "\x1f").alias("m"))
    return found.select("doc_id", "ord", F.get("m", F.lit(0)).alias("masked"), (F.size("m") - 1).cast("long").alias("pieces"))


@query("s_10_unmask", with_(blocks(DUCK)) + "SELECT doc_id, ord, true AS same FROM blocks")
def unmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: unmask(mask(text)) is the text."""
    marked = F.regexp_replace(F.regexp_replace("text", "(the) ", "**$1** "), "(was|und|que) ", "[$1](http://example.org/$1) ")
    back = _column("boolean", lambda t: prose.unmask(*prose.mask(t)) == t)
    return _blocks(spark, sf_dir).select("doc_id", "ord", back(marked).alias("same"))


LEXICON = {"annos": "anos", "elle": "ele", "ella": "ela", "pharmacia": "farmácia", "theatro": "teatro"}


def _spelling_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words with their counts, of one pass over the texts; a lexicon; words of today (those of three texts or more); accented words whose plain form none of them is."""
    counted = run_sql(spark, sf_dir, f"SELECT word, count(*) AS times, count(DISTINCT doc_id) AS texts FROM (SELECT doc_id, explode(regexp_extract_all(text, {SPARK.lit(spelling.WORD)}, 0)) AS word FROM documents) q GROUP BY word")
    words = tables.kept(counted, "words")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "old string, new string")
    known = words.where("texts >= 3").select(F.lower("word").alias("word")).distinct()
    plain = known.select(F.col("word").alias("accented"), F.translate("word", "áâãàéêíóôõúüç", "aaaaeeiooouuc").alias("base"))
    single = plain.groupBy("base").agg(F.count(F.lit(1)).alias("forms"), F.max("accented").alias("accented")).where("forms = 1 AND base <> accented")
    return words, lexicon, known, single.select("base", "accented")


@query("s_21_modernise")
def modernise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words are modernised once each, and joined back to their counts."""
    words, lexicon, known, accents = _spelling_tables(spark, sf_dir)
    return spelling.modernise(words.select("word"), lexicon, accents, known).join(words, "word").select("word", "times", "modern")


@query("s_21_modernise_without_dictionary")
def modernise_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, lexicon, _, accents = _spelling_tables(spark, sf_dir)
    return spelling.modernise(words.select("word"), lexicon, accents)


@query("s_22_repairs")
def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are not of today and that one repair or two lead to just one word that is."""
    words, _, known, accents = _spelling_tables(spark, sf_dir)
    odd = words.select(F.lower("word").alias("word")).distinct().join(known, "word", "left_anti")
    return spelling.repairs(odd, known, accents)


@query("agg_16_scoreboard")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted errors by type: cases, those that the rules catch, that an auditor does (here: three of four, by number), that either does, and
    what stands after a judge, who upholds half of what is not locked."""
    alerts = checks.checks(F.col("src"), F.col("out"), "translate", of_source=F.col("_of"))
    found = frames.planted_pairs(spark, sf_dir, {"_of": checks.asked(F.col("src"))}).withColumn("alerts", alerts)
    rules, auditor = F.size("alerts") > 0, (F.col("type") != "clean") & ((F.col("conv_id") + F.col("turn")) % 4 > 0)
    stands = F.exists("alerts", checks.locked) | (rules | auditor) & (F.col("conv_id") % 2 == 0)
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("cases"), F.count_if(rules).alias("rules"), F.count_if(auditor).alias("auditor"), F.count_if(rules | auditor).alias("either"), F.count_if(stands).alias("standing"))


@query("src_02_digital_formats")
def digital_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format by extension and magic; html pages are read as text, and fail below 0.7 of the expected size."""
    pages = table(spark, sf_dir, "pages")
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]+>", " "))
    kept = F.length(text) >= 0.7 * F.length(F.regexp_replace("html", "(?s)<[^>]+>", ""))
    return pages.select("page_id", F.when(F.lower(F.substring("html", 1, 9)) == "<!doctype", "html").otherwise("txt").alias("format"), F.length(text).cast("long").alias("n_chars"), kept.alias("whole"))


@query("src_03_epub_order", with_(lines(DUCK)) + "SELECT doc_id, ord AS place, '<p>' || regexp_replace(line, '[<>&]', ' ', 'g') || '</p>' AS body FROM lines")
def epub_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters in spine order from EPUB archives that are made of all of a document's lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                chapters = (text or "").split("\n")
                rows += [(doc, k, name, body) for k, (name, body) in enumerate(epub.chapters(epub.pack(chapters)))]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "name", "body"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, place long, name string, body string").select("doc_id", "place", "body")


operator("src_11_notes_links", lambda d: with_(lines(d)) + f", t AS (SELECT doc_id, ord, concat('[', line, '](#n', CAST(ord AS STRING), ') [w](http://example.org)') AS md FROM lines WHERE NOT {d.has('line', r'[\]\[()]')}) SELECT doc_id, ord, {d.rx('md', r'\[([^\]]*)\]\(#[^)]*\)', '$1')} AS text FROM t")


@query("src_05_page_text_unescaped")
def page_text_unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page to text with all character references of HTML, as books are read."""
    more = F.concat("html", F.lit("<p>caf&eacute; &#8212; &#x41;&hellip; &notit; &lt;b&gt;"))
    return table(spark, sf_dir, "pages").select("page_id", _column("string", books.page_text)(more).alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha"))


@query("src_13_json_state")
def json_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in text, read permissively: broken records are null."""
    broken = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(broken, "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


# SRC-17: the queue's table of items: rows of a former version lack two columns, which read as empty and null; one row for each key, the latest.
SRC_17 = """WITH former AS (SELECT conv_id AS job, turn AS k, text AS source_text, 'queued' AS state, 1 AS version FROM conversations WHERE turn % 2 = 0),
  latter AS (SELECT conv_id AS job, turn AS k, text AS source_text, CASE WHEN conv_id % 3 = 0 THEN 'approved' ELSE 'review' END AS state, CASE WHEN conv_id % 5 = 0 THEN '{}' END AS verdict, 'ctx' AS context, 2 AS version FROM conversations WHERE turn % 3 = 0),
  every AS (SELECT job, k, source_text, state, NULL AS verdict, '' AS context, version FROM former UNION ALL SELECT * FROM latter),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY job, k ORDER BY version DESC, source_text) AS nth FROM every)
  SELECT job, k, length(source_text) AS chars, state, verdict, context FROM ranked WHERE nth = 1"""


@query("src_17_job_tables", SRC_17)
def job_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of two versions of the table, as one table with its key."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("k"), F.col("text").alias("source_text"))
    former = rows.where("k % 2 = 0").withColumns({"state": F.lit("queued"), "version": F.lit(1)})
    state = F.when(F.col("job") % 3 == 0, "approved").otherwise("review")
    latter = rows.where("k % 3 = 0").withColumns({"state": state, "verdict": F.when(F.col("job") % 5 == 0, "{}"), "context": F.lit("ctx"), "version": F.lit(2)})
    found = tables.latest(tables.migrated(former, latter, {"context": ""}), ["job", "k"], [F.desc("version"), F.asc("source_text")])
    return found.select("job", "k", F.length("source_text").cast("long").alias("chars"), "state", "verdict", "context")


@query("src_19_atom_catalogue")
def atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("<feed><entry><id>https://example.org/ebooks/"), F.col("p_partkey").cast("string"), F.lit(".opds</id><title>"), F.col("p_name"), F.lit(" (English)</title></entry></feed>"))
    read = _column("string", lambda t: "|".join(prose.atom_entries(t)[0]))
    return table(spark, sf_dir, "part").select("p_partkey", read(entry).alias("entry"))


# SRC-23: images of a page that cover a fiftieth of it or more, up to the first that covers 0.7 (the whole page); a book's first page that is an image
# and nothing else is its cover. Pages are orders here, images their lines; every third order is without text, and 97 books share the orders.
operator(
    "src_23_page_images",
    lambda d: """WITH i AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS image, max(CAST(l_quantity AS DOUBLE)) / 50 AS share FROM lineitem GROUP BY l_orderkey, l_linenumber),
    w AS (SELECT page, min(CASE WHEN share >= 0.7 THEN image END) AS whole FROM i GROUP BY page),
    c AS (SELECT page % 97 AS book, min(page) AS cover FROM w WHERE whole IS NOT NULL AND page % 3 = 0 GROUP BY page % 97)
    SELECT i.page, i.image, i.share >= 0.7 AS whole_page, coalesce(i.page = c.cover AND i.share >= 0.7, false) AS cover FROM i JOIN w ON i.page = w.page LEFT JOIN c ON c.book = i.page % 97 WHERE i.share >= 0.02 AND (w.whole IS NULL OR i.image <= w.whole)""",
)


@query("st_04_stage_machine")
def stage_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*map(F.lit, ("diagnosis", "inventory", "extraction", "structure", "transformation", "draft")))
    done = F.slice(stages, 1, (F.col("doc_id") % 7).cast("int"))
    rest = F.array_except(stages, done)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.get(rest, F.lit(0)), F.lit("finished")).alias("following"), F.size(done).cast("long").alias("done"))


@query("st_08_book_queue")
def book_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue machine, a user's events as its ticks."""
    return table(spark, sf_dir, "events").groupBy("user_id").applyInPandas(queue.replay, queue.SCHEMA)


@query("st_14_loop_cut")
def loop_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    looped = F.concat("text", F.lit(" "), "text")
    return _blocks(spark, sf_dir).select("doc_id", "ord", _column("long", lambda t: len(align.cut_repetition(t)))(looped).alias("kept"))


def _snk_01(d) -> str:
    return with_(blocks(d)) + f"SELECT doc_id, CAST(count(*) AS BIGINT) AS blocks, {d.sha(d.join(d.collect('text', 'ord'), chr(10) * 2))} AS sha FROM blocks WHERE ord > 0 GROUP BY doc_id"


@query("snk_01_atomic_write", _snk_01(DUCK))
def atomic_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as a table, and written again without their headings: readers see either version whole. What is read back."""
    body = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s.text)
    books = lambda rows: rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sha2(F.array_join(body, "\n\n"), 256).alias("sha"))
    place = tables.own_place(spark, "books")
    tables.replace_table(books(_blocks(spark, sf_dir)), place)
    tables.replace_table(books(_blocks(spark, sf_dir).where("ord > 0")), place)
    return tables.read_table(spark, place)


@query("s_18_checks_messages")
def checks_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules with their messages, over planted errors; the glossary holds two terms."""
    terms = (("the", "anly"), ("tion", "shst"))
    found = frames.planted_pairs(spark, sf_dir, {"_of": checks.asked(F.col("src"), "translate", terms)})
    alerts = checks.checks(F.col("src"), F.col("out"), "translate", terms, of_source=F.col("_of"))
    return found.select("conv_id", "turn", "type", F.posexplode(alerts).alias("nth", "message")).withColumn("locked", checks.locked(F.col("message")))


@query("s_18_checks_same_language")
def checks_same_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of spelling tasks, and whether more than spelling changed."""
    found = frames.planted_pairs(spark, sf_dir).withColumn("_same", editions.same_words(F.col("src"), F.col("out")))
    alerts = checks.checks(F.col("src"), F.col("out"), "modernise", same_words=F.col("_same"))
    return found.select("conv_id", "turn", "type", F.array_join(alerts, "; ").alias("alerts"), (F.col("_same") < editions.SAME).alias("beyond_spelling"))


@query("aln_01_edition_summary")
def edition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its own text with one line in seven gone."""
    own = _blocks(spark, sf_dir).withColumnRenamed("doc_id", "book")
    copies = own.where("ord % 7 != 3").groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s.text), "\n").alias("text"))
    return editions.summary(editions.compare_editions(own, copies))


@query("blk_07_continuation_api")
def continuation_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = structure.continuations(_blocks(spark, sf_dir))
    return merged.select("doc_id", "block", "kind", F.size("pages").cast("long").alias("pages"), F.sha2("text", 256).alias("sha"))


@query("join_03_asof_api")
def asof_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    commits = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("commit"))
    return joins.as_of_following(events.where("event_type = 'view'"), commits, "user_id", "ts", "commit")
