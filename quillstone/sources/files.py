"""Files of many kinds as rows: scanning, unpacking, decoding, parsing, with an error channel; and sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean, strip
from ..operators.decisions import any_of
from ..operators.lexicons import EXAM
from ..operators.similarity import normalised
from ..operators.vectors import vector_blocks
from . import snapshots

# Fixed value: how a binary DOC begins.
OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
ENDINGS = ("txt", "docx", "doc", "pdf")
#: The longest value that a binary column can hold; a longer member is an error row.
MOST_MEMBER = (1 << 31) - 1


def scan(spark: SparkSession, root: str, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """path, length, content of all files below root with one of the endings (any case), lock files aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.regexp_like(F.lower(name), F.lit(rf"\.({'|'.join(endings)})$")) & ~F.startswith(name, F.lit("~$"))).select("path", "length", "content")


def repaired(name: str, flags: int) -> str:
    """A member's name that an archive without the UTF-8 flag wrote as code page 437."""
    if flags & 0x800:
        return name
    try:
        raw = name.encode("cp437")
    except UnicodeEncodeError:
        return name
    for code in ("utf-8", "big5"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            pass
    return name


def members(path: str, content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, error) of all files in an archive, archives within it included."""
    todo = [(path, content)]
    while todo:
        at, data = todo.pop()
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            yield at, None, "bad_archive"
            continue
        for m in z.infolist():
            name = f"{at}!{repaired(m.filename, m.flag_bits)}"
            if m.is_dir():
                continue
            if m.file_size > MOST_MEMBER:
                yield name, None, "too_large"
                continue
            try:
                inner = z.read(m)
            except Exception as e:  # encrypted or damaged members are error rows
                yield name, None, f"corrupted: {type(e).__name__}"
                continue
            if name.lower().endswith(".zip"):
                todo.append((name, inner))
            else:
                yield name, inner, None


def unpack(files: DataFrame) -> DataFrame:
    """files(path, content) of archives -> path, content, error: one row for each member."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                for member in members(p, c or b""):
                    yield pd.DataFrame([member], columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")


def decoded(data: bytes) -> str:
    """UTF-8, else Big5, else code page 950, else UTF-8 without what is broken. The text is not normalised."""
    for code in ("utf-8", "big5", "cp950"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "ignore")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ").strip() for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) if rows else ""


def docx_text(data: bytes) -> str:
    """Paragraphs and tables in the order of the body, tables as Markdown, joined by empty lines."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    parts = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and said(e).strip():
            parts.append(said(e).strip())
        elif e.tag == f"{_W}tbl":
            parts.append(markdown([["\n".join(said(p) for p in c.iter(f"{_W}p")) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]))
    return "\n\n".join(p for p in parts if p)


def parse_file(path: str, data: bytes | None) -> tuple[str, str | None, str]:
    """(status, reason, text): exactly one of parsed and failed."""
    end = path.rsplit(".", 1)[-1].lower()
    if not data:
        return "failed", "empty", ""
    try:
        if end == "txt":
            return "ok", None, decoded(data)
        if end == "docx":
            # A binary DOC under another name: it needs a converter, and is no damaged DOCX.
            return ("failed", "binary_doc", "") if data.startswith(OLE) else ("ok", None, docx_text(data))
    except (zipfile.BadZipFile, KeyError):
        return "failed", "not_a_docx", ""
    except ElementTree.ParseError:
        return "failed", "corrupted", ""
    # PDF text, OCR and binary DOC need tools that are not part of this library.
    return "failed", f"no_reader_for_{end}", ""


def parse_files(files: DataFrame) -> DataFrame:
    """path, status, reason, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *parse_file(p, c)) for p, c in zip(f["path"], f["content"], strict=True)], columns=["path", "status", "reason", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, status string, reason string, text string")


def open_error(message: Column) -> Column:
    """encrypted or corrupted, by what a reader said when it failed; null where it did not."""
    return F.when(F.regexp_like(F.lower(message), F.lit("password|encrypt")), "encrypted").when(message.isNotNull(), "corrupted")


def joined_pages(pages: DataFrame, path: str = "path", text: str = "text", page: str = "page") -> DataFrame:
    """path, text: a file's pages in order, empty ones left out, joined by an empty line and cleaned."""
    own = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    texts = F.filter(F.transform(own, lambda x: x["t"]), lambda t: F.length(F.trim(F.coalesce(t, F.lit("")))) > 0)
    return pages.groupBy(path).agg(F.array_join(texts, "\n\n").alias(text)).withColumn(text, clean(F.col(text)))


#: Characters that recognised text must have to count as text.
LEAST_OCR = 50


def settled(parsed: DataFrame, how: str = "how", text: str = "text", status: str = "status", reason: str = "reason") -> DataFrame:
    """Recognised text of fewer than LEAST_OCR characters is a failure of its own kind; other rows stay as they are."""
    short = (F.col(how) == "ocr") & (F.col(status) == "ok") & (F.length(F.coalesce(F.col(text), F.lit(""))) < LEAST_OCR)
    return parsed.withColumn(reason, F.when(short, "ocr_no_text").otherwise(F.col(reason))).withColumn(status, F.when(short, "failed").otherwise(F.col(status)))


def classify_pages(pages: DataFrame, path: str = "path", text: str = "text", has_table: str = "has_table", page: str = "page", error: str | None = None) -> DataFrame:
    """Per file, from its pages (one with a null page if it has none): encrypted or corrupted, by the reader's message in
    the column `error`, if one is named; empty, needs_ocr (font codes in 15 of 100 characters of the first five pages, or fewer
    than 30 characters a page, white space at a page's ends aside), has_tables or normal_text."""
    t = F.coalesce(F.col(text), F.lit(""))
    codes = F.length(t) - F.length(F.regexp_replace(t, r"\(cid:[0-9]+\)", ""))
    early = F.col(page) <= 5
    a = pages.groupBy(path).agg(
        F.count(F.col(page)).alias("n_pages"), F.avg(F.length(strip(t))).alias("avg_chars"), F.bool_or(F.coalesce(F.col(has_table), F.lit(False))).alias("tables"),
        F.sum(F.when(early, codes).otherwise(0)).alias("codes"), (F.sum(F.when(early, F.length(t)).otherwise(0)) + F.greatest(F.count_if(early) - 1, F.lit(0))).alias("chars"),
        F.max(F.col(error) if error else F.lit(None).cast("string")).alias("message"),
    )
    ratio = F.when(F.col("chars") > 0, F.col("codes") / F.col("chars")).otherwise(0.0)
    kind = F.when(F.col("message").isNotNull(), open_error(F.col("message"))).when(F.col("n_pages") == 0, "empty").when((ratio >= 0.15) | (F.col("avg_chars") < 30), "needs_ocr").when(F.col("tables"), "has_tables").otherwise("normal_text")
    return a.select(path, "n_pages", "avg_chars", kind.alias("kind"))


def notices(rows: DataFrame, file: str = "file", cells: str = "cells") -> DataFrame:
    """Table rows of penalty reports: year and month from the file name, eight cells or more with digits in the first;
    the amount's digits (0 if none), the article cited."""
    year, month = (F.regexp_extract(file, r"(11[4-9])年(\d{1,2})月", i) for i in (1, 2))
    cell = lambda i: F.get(F.col(cells), F.lit(i))
    kept = rows.filter((F.size(cells) >= 8) & F.regexp_like(F.trim(cell(0)), F.lit("^[0-9]+$")) & (year != ""))
    digits = F.regexp_replace(F.coalesce(cell(6), F.lit("")), "[^0-9]", "")
    article = F.regexp_extract(F.coalesce(cell(7), F.lit("")), r"第\s*(\d+)(?:之\d+)?\s*條", 1)
    return kept.select(
        file, year.cast("int").alias("year"), month.cast("int").alias("month"), *[F.trim(cell(i)).alias(n) for i, n in enumerate(("no", "date", "product", "channel", "violation", "company"))],
        F.when(digits != "", digits.cast("long")).otherwise(0).alias("penalty"), F.trim(cell(7)).alias("law_cited"), F.when(article != "", article.cast("int")).alias("article_no"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; empty lines are skipped; a missing file is an empty table."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions; the source is "manual" where it is not given."""
    df = spark.read.option("multiLine", True).schema("question string, gold_chunk_id long, source string").json(path)
    return df.withColumn("source", F.coalesce("source", F.lit("manual")))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_nouns(spark: SparkSession, path: str) -> DataFrame:
    """noun, cid: a JSON object of nouns, each with a list of ids; a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "noun string, cid long")
    held = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<bigint>>").alias("m"))
    return held.select(F.explode("m").alias("noun", "ids")).select("noun", F.explode("ids").alias("cid"))


def write_nouns(nouns: DataFrame, path: str) -> None:
    """nouns(noun, cid) as one JSON object: a lexicon, so small."""
    lists = nouns.groupBy("noun").agg(F.sort_array(F.collect_set("cid")).alias("ids"))
    lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("noun", "ids")))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_prompt(spark: SparkSession, path: str) -> str:
    """A prompt template; a missing file is an empty text."""
    if not _exists(spark, path):
        return ""
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).toLocalIterator())


def write_vectors(chunks: DataFrame, path: str, key: str = "cid", vector: str = "embedding", cells: int = 64) -> None:
    """The vector collection, rebuilt as a whole: unit vectors in blocks of near ones, each with its mean and radius, as
    search_blocks() reads them. A null vector is left out, as it is in no index."""
    rows = chunks.filter(F.col(vector).isNotNull()).select(F.col(key), normalised(F.col(vector)).alias(vector))
    snapshots.write(vector_blocks(rows, key, vector, cells), path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, null fields kept."""
    results.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def rewrite(spark: SparkSession, root: str, make: Callable[[DataFrame], DataFrame]) -> bool:
    """Replaces a table below root (see snapshots) by make(table). The version before it stays as the backup, and those
    before that go. False, and nothing done, where nothing changes."""
    if snapshots.update(spark, root, make) is None:
        return False
    snapshots.vacuum(spark, root, 2)
    return True


def read_splits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a folder split=... for each part becomes the column split."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)


def numbered(df: DataFrame, order: list[str], name: str = "id", parts: int = 64) -> DataFrame:
    """Ids from 1 by a fixed order of distinct keys: the id is the number of keys at or before a row's. Keys are cut into
    parts at fixed bounds of the first column, counted, and numbered within their part; nothing rests on how
    a shuffle happened to deal them, so a task that runs again gives the same ids."""
    first = F.col(order[0])
    bounds = [r[0] for r in df.select(first.alias("b")).filter("b is not null").distinct().orderBy(F.xxhash64("b"), "b").limit(parts).sort("b").toLocalIterator()]
    place = sum([F.when(first > F.lit(b), 1).otherwise(0) for b in bounds], F.lit(0))
    rows = df.withColumn("_part", F.when(first.isNull(), -1).otherwise(place))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each part.
    before = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_i", own).join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, F.col("_base") + F.col("_i")).drop("_part", "_p", "_i", "_base")


def write_tables(chunks: DataFrame, root: str) -> None:
    """The chunk table and its edge list, rebuilt as a whole and replaced together: "chunks" without their references, and
    "chunk_laws", a row for each reference. chunks has id and refs (array of structs)."""
    snapshots.write_set({"chunks": chunks.drop("refs"), "chunk_laws": chunks.select(F.col("id").alias("chunk_id"), F.inline("refs"))}, root)


def write_parsed(chunks: DataFrame, notices_: DataFrame, parsed: DataFrame, root: str) -> None:
    """The three results of a run as JSON lines: chunks and notices, numbered by a fixed order and not by when they
    came, and the failed files."""
    numbered(chunks, ["path", "chunk_no"]).write.mode("overwrite").json(f"{root}/chunks")
    numbered(notices_, ["file", "no"]).write.mode("overwrite").json(f"{root}/notices")
    write_failed(parsed, root)


def write_failed(parsed: DataFrame, root: str) -> None:
    parsed.filter("status = 'failed'").select("path", "reason", F.current_timestamp().alias("detected_at")).write.mode("overwrite").json(f"{root}/failed")


# Where the questions with options begin, the head and foot of a page, a question's number, an option's letter.
_PART = "測驗題部分"
_EDGES = r"代號：\d+\r?\n頁次：\d+－\d+(?:\r?\n)?"
_QUESTION, _OPTION = r"(?U)^\s*(\d{1,3})[.、．\s]\s*(.*)$", r"(?U)^\s*[(（]?([A-D])[)）.、．]\s*(.*)$"


def exam_lines(paper: Column) -> Column:
    """The lines of a paper's questions with options: from the part that is headed so, if there is one; without the heads
    and feet of pages, empty lines, and white space at their ends; full-width letters as plain ones."""
    at = F.instr(paper, _PART)
    own = F.when(at > 0, F.substr(paper, at + len(_PART))).otherwise(paper)
    lines = F.split(F.translate(F.regexp_replace(own, _EDGES, ""), "ＡＢＣＤ", "ABCD"), r"\r?\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")


def exam_items(paper: Column) -> Column:
    """array<struct(no, stem, options)> of a paper, in order: a line with the next number begins a question, one with a
    letter an option of it, and any other goes on with what stands before. What stands before the first question is
    left out; a number that does not go on from the last question's is part of the text; of a letter that comes twice
    the last counts. Null: null."""
    nothing = F.create_map().cast("map<string,string>")
    finished = lambda s: F.when(s["no"].isNull(), s["done"]).otherwise(F.array_append(s["done"], F.struct(s["no"].alias("no"), s["stem"].alias("stem"), s["options"].alias("options"))))

    def state(done: Column, no: Column, stem: Column, options: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), no.alias("no"), stem.alias("stem"), options.alias("options"), open_.alias("open"))

    text = F.lit(None).cast("string")
    none = state(F.array().cast("array<struct<no:int,stem:string,options:map<string,string>>>"), F.lit(None).cast("int"), text, nothing, text)

    def put(options: Column, letter: Column, text: Column) -> Column:
        return F.map_concat(F.map_filter(options, lambda k, _: k != letter), F.create_map(letter, text))

    def step(s: Column, line: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(line, pattern, i)
        number, letter = F.try_to_number(F.nullif(part(_QUESTION, 1), F.lit("")), F.lit("999")).cast("int"), part(_OPTION, 1)
        begins = number.isNotNull() & (letter == "") & (s["no"].isNull() | (number == s["no"] + 1))
        return (
            F.when(F.coalesce(begins, F.lit(False)), state(finished(s), number, strip(part(_QUESTION, 2)), nothing, text))
            .when(s["no"].isNull(), s)
            .when(letter != "", state(s["done"], s["no"], s["stem"], put(s["options"], letter, strip(part(_OPTION, 2))), letter))
            .when(s["open"].isNotNull(), state(s["done"], s["no"], s["stem"], put(s["options"], s["open"], F.concat(F.element_at(s["options"], s["open"]), strip(line))), s["open"]))
            .otherwise(state(s["done"], s["no"], F.concat(s["stem"], strip(line)), s["options"], s["open"]))
        )

    return F.aggregate(exam_lines(paper), none, step, finished)


def answer_key(sheet: Column) -> Column:
    """array<struct(no, answer)> of an answer sheet: a line of numbers that begins with 題號, and the line of letters after
    it that begins with 答案; letters other than A to D are left out."""
    lines = F.transform(F.split(sheet, "\\r?\\n"), lambda x: strip(F.translate(x, "ＡＢＣＤ", "ABCD")))
    pairs = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("nos"), F.get(lines, i + 1).alias("letters"))), lambda p: F.startswith(p["nos"], F.lit("題號")) & F.startswith(p["letters"], F.lit("答案")))
    one = F.transform(pairs, lambda p: F.arrays_zip(F.regexp_extract_all(p["nos"], F.lit(r"第?(\d+)題?"), F.lit(1)).alias("no"), F.regexp_extract_all(F.regexp_replace(F.substr(p["letters"], F.lit(3)), r"\s+", ""), F.lit("(.)"), F.lit(1)).alias("answer")))
    known = F.filter(F.flatten(one), lambda x: x["no"].isNotNull() & F.coalesce(x["answer"].isin("A", "B", "C", "D"), F.lit(False)))
    return F.transform(known, lambda x: F.struct(x["no"].cast("int").alias("no"), x["answer"].alias("answer")))


def about_rules(stem: Column, options: Column, cues: tuple[str, ...] = EXAM) -> Column:
    """Whether a question's text or options have a cue of the rules."""
    return any_of(F.concat(stem, F.array_join(F.map_values(options), "")), cues)


def exam_table(files: DataFrame, keys: DataFrame) -> DataFrame:
    """files(year, text), keys(year, no, answer) -> year, no, stem, options, answer: the questions with four options and an
    answer among them. Null texts have none; a question with several answers has a row for each."""
    items = files.select("year", F.inline(exam_items(F.col("text")))).filter(F.size("options") == 4)
    found = items.join(keys.select("year", "no", "answer"), ["year", "no"])
    return found.filter(F.map_contains_key("options", F.col("answer"))).select("year", "no", "stem", "options", "answer")
