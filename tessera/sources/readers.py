"""Reading documents, manifests, golden sets and binary files."""

from __future__ import annotations

import os
import urllib.robotparser
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import SCHEMAS

_FIELDS = {name: ", ".join(f.strip().replace(" ", ": ", 1) for f in SCHEMAS[name].split(",")) for name in ("document_meta", "section_nodes")}
PARSED = (
    f"meta struct<{_FIELDS['document_meta']}>, full_text string, nodes array<struct<{_FIELDS['section_nodes']}>>, "
    "page_texts array<string>, parser string, warnings array<string>, _corrupt string"
)


def parsed_documents(spark: SparkSession, folder: str, only: list[str] | None = None, tolerant: bool = True) -> DataFrame:
    """One JSON file per document in the order of their paths; index.json is none. Broken files are skipped, or fail."""
    reader = spark.read.schema(PARSED).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    rows = reader.option("mode", "PERMISSIVE" if tolerant else "FAILFAST").json(f"{folder}/*.json")
    rows = rows.withColumn("path", F.col("_metadata.file_path")).filter(~F.col("path").endswith("/index.json"))
    if tolerant:
        rows = rows.filter(F.col("_corrupt").isNull())
    if only is not None:
        rows = rows.filter(F.col("meta.doc_id").isin(only))
    return rows.drop("_corrupt").orderBy("path")


def manifest(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """The records of a JSON array; those without doc_id are skipped. A missing file is an error."""
    rows = spark.read.schema(SCHEMAS["manifest"]).option("multiLine", True).json(path).filter(F.col("doc_id").isNotNull())
    return rows if only is None else rows.filter(F.col("doc_id").isin(only))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, q, doc, type, clause) of a JSON object with a list of questions."""
    schema = "questions array<struct<q: string, doc: string, type: string, clause: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.posexplode("questions").alias("question_id", "x")).select(F.col("question_id").cast("long").alias("question_id"), "x.*")


def binary_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, file_name, n_bytes, sha256, content)."""
    rows = spark.read.format("binaryFile").load(glob)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def extract_pages(files: DataFrame, extractor: Callable[[bytes], list[str]], recogniser: Callable[[bytes, int], str] | None = None, least_chars: int = 50) -> DataFrame:
    """(doc_id, page_no, text, ocr, warning) of files (doc_id, content).

    A page with fewer characters than least_chars is read by the recogniser. If that raises RuntimeError it is not tried
    again for the document's later pages; any other error leaves the page empty. Both leave a warning.
    """

    def run(batches):
        for files_ in batches:
            rows = []
            for doc_id, content in zip(files_["doc_id"], files_["content"]):
                read = recogniser
                try:
                    pages = extractor(content)
                except Exception as e:  # noqa: BLE001 - a file that cannot be read must not end the job
                    rows.append((doc_id, 1, "", False, f"extract: {e}"))
                    continue
                for n, text in enumerate(pages, 1):
                    text, ocr, warning = text or "", False, None
                    if len(text.strip()) < least_chars and read is not None:
                        try:
                            text, ocr = read(content, n), True
                        except RuntimeError as e:
                            read, warning = None, f"ocr off: {e}"
                        except Exception as e:  # noqa: BLE001
                            text, warning = "", f"ocr page {n}: {e}"
                    rows.append((doc_id, n, text, ocr, warning))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "ocr", "warning"])

    return files.select("doc_id", "content").mapInPandas(run, SCHEMAS["pages"])


def first_recogniser(*choices: Callable[[], Callable[[bytes, int], str]]) -> Callable[[bytes, int], str]:
    """The recogniser of the first of the makers that works here, in the given order; RuntimeError if none does."""
    failed = []
    for make in choices:
        try:
            return make()
        except Exception as e:  # noqa: BLE001 - an engine that is not installed is passed over
            failed.append(str(e))
    raise RuntimeError("no recogniser: " + "; ".join(failed))


def scanned_pages(files: DataFrame, scan: Callable[[bytes], tuple[int, list[tuple[int, str, object]]]], extractor: Callable[[bytes], list[str]], **how) -> DataFrame:
    """Pages (as in extract_pages) by a table-aware scan: (number of pages, items in reading order), an item being (page_no,
    'text', its text) or (page_no, 'table', its rows). Tables come out as markdown, pages without items empty. A file
    whose scan fails is read by the extractor.
    """

    def run(batches):
        for part in batches:
            rows = []
            for doc_id, content in zip(part["doc_id"], part["content"]):
                try:
                    n, items = scan(content)
                    text: list[list[str]] = [[] for _ in range(max(1, n))]
                    for page, kind, value in items:
                        shown = markdown_table(value) if kind == "table" else (value or "").strip()
                        if shown:
                            text[page - 1].append(shown)
                    rows += [(doc_id, i, "\n".join(t), False, None) for i, t in enumerate(text, 1)]
                except Exception as e:  # noqa: BLE001 - the plain extractor takes over
                    rows.append((doc_id, 0, "", False, f"scan: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "ocr", "warning"])

    found = files.select("doc_id", "content").mapInPandas(run, SCHEMAS["pages"]).persist()
    failed = found.filter("page_no = 0").select("doc_id")
    rest = extract_pages(files.join(failed, "doc_id", "left_semi"), extractor, **how)
    return found.filter("page_no > 0").unionByName(rest)


def markdown_table(rows) -> str:
    """Rows of cells as a markdown table, the first one as its head; an empty string for what is no table."""
    try:
        cells = [[str(c if c is not None else "").replace("|", "\\|").replace("\n", " ").strip() for c in r] for r in rows]
    except TypeError:
        return ""
    if not cells or not any(any(r) for r in cells):
        return ""
    width = max(map(len, cells))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def resolve_source(spark: SparkSession, source: str, doc_id: str, raw: str, fetch: Callable[[str], bytes | None] | None = None) -> str:
    """Puts a document's file at raw/<doc_id>.pdf, copied or fetched; gives that path. FileNotFoundError: there is no such
    file; RuntimeError: the address cannot be fetched."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{raw}/{doc_id}.pdf")
    to = target.getFileSystem(conf)
    if source.startswith(("http://", "https://")):
        content = fetch(source) if fetch else None
        if content is None:
            raise RuntimeError(f"cannot fetch {source}")
        out = to.create(target, True)
        out.write(bytearray(content))
        out.close()
    else:
        path = jvm.org.apache.hadoop.fs.Path(source if "://" in source else "file://" + os.path.abspath(os.path.expanduser(source)))
        own = path.getFileSystem(conf)
        if not own.exists(path):
            raise FileNotFoundError(source)
        jvm.org.apache.hadoop.fs.FileUtil.copy(own, path, to, target, False, True, conf)
    return target.toString()


def may_fetch(links: DataFrame, robots: str | None, agent: str) -> DataFrame:
    """Adds allowed to links (url): what robots.txt lets the agent fetch; without one everything is allowed."""

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series) -> pd.Series:
        rules = urllib.robotparser.RobotFileParser()
        rules.parse((robots or "").splitlines())
        return url.map(lambda u: u is not None and (robots is None or rules.can_fetch(agent, u)))

    return links.withColumn("allowed", allowed("url"))


def crawl_delay(robots: str | None, agent: str, default: float = 3.0) -> float:
    """The seconds that robots.txt asks the agent, else anybody, to wait."""
    rules = urllib.robotparser.RobotFileParser()
    rules.parse((robots or "").splitlines())
    return float(rules.crawl_delay(agent) or rules.crawl_delay("*") or default)
