"""Documents from files: routing by extension, decoding, ingest."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textreuse.functions.columns import checksum, clean_document, guess_language
from textreuse.operators.chunks import sliced
from textreuse.sources.office import doc_text

UPLOADS = ("pdf", "docx", "doc", "txt", "md")
MAX_BYTES = 20 << 20
#: Formats with a parser of their own.
SPECIAL = ("docx", "doc", "pdf")
# Names without an extension that are text.
PLAIN_NAMES = (
    "dockerfile containerfile makefile gnumakefile rakefile gemfile guardfile capfile thorfile vagrantfile berksfile puppetfile "
    "procfile appfile buildfile workspace license licence copyright copying readme changelog history changes authors contributors "
    "acknowledgments credits install installation news releases todo tasks bugs issues roadmap milestones faq questions "
    "contributing code_of_conduct security notice disclaimer manifest version config configure setup requirements dependencies"
).split()
#: Suffixes of text: prose, tables, settings, code. Others can be passed in.
TEXT = (
    "txt text md markdown mdx rst adoc asciidoc org tex bib log nfo csv tsv psv json jsonl ndjson json5 xml xsd xsl xslt dtd rss atom svg yaml yml toml ini cfg conf config env "
    "properties plist html htm xhtml css scss sass less js mjs cjs jsx ts tsx vue svelte astro py pyi pyx pyw ipynb rb erb gemspec php phtml java kt kts scala sc groovy gradle clj cljs "
    "c h cc cpp cxx hpp hh hxx inl ino cs fs fsx vb go rs swift m mm dart lua pl pm r rmd jl hs lhs ml mli elm ex exs erl hrl nim zig d pas pp f f90 f95 for asm s v sv vhd vhdl "
    "sh bash zsh fish csh ksh bat cmd ps1 psm1 awk sed sql ddl graphql gql proto thrift avsc cmake mk tf tfvars hcl nix dockerignore gitignore gitattributes editorconfig srt vtt ass po pot ics vcf eml diff patch "
    "rtf tcl lisp lsp cl el scm rkt vbs coffee haml jade pug mustache hbs liquid twig jsp asp aspx cob cbl ada adb ads f03 f08 sln csproj vbproj mak bzl kotlin edn pod cls sty"
).split()


def text_suffixes() -> frozenset[str]:
    return frozenset(TEXT)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))


def parser_of(path: Column, suffixes: frozenset[str] | None = None) -> Column:
    """docx, doc, pdf, text, plain (a known name without extension) or null."""
    ext, name = extension(path), F.lower(F.regexp_extract(path, r"([^/\\]+)\z", 1))
    known = sorted(suffixes if suffixes is not None else text_suffixes())
    return F.when(ext.isin(*SPECIAL), ext).when(ext.isin(*known), "text").when((ext == "") & name.isin(*PLAIN_NAMES), "plain")


def supported_format(path: Column) -> Column:
    return parser_of(path).isNotNull()


def format_stats(spark: SparkSession) -> DataFrame:
    """Number of known formats by parser."""
    rows = [(x, x) for x in SPECIAL] + [(x, "text") for x in sorted(text_suffixes())] + [(x, "plain") for x in PLAIN_NAMES]
    return spark.createDataFrame(rows, "name string, parser string").groupBy("parser").agg(F.count("*").alias("n"))


def decode(content: bytes) -> str | None:
    """UTF-8 without what is not; Latin-1 where nothing is left."""
    text = content.decode("utf-8", "ignore")
    return text if text.strip() else content.decode("latin-1") or None


def docx_text(content: bytes) -> str | None:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n\n".join(p for p in paragraphs if p.strip()) or None


def pdf_text(content: bytes) -> str | None:
    from pypdf import PdfReader  # optional

    text = "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip() or None


PARSERS: dict[str, Callable[[bytes], str | None]] = {"text": decode, "plain": decode, "docx": docx_text, "pdf": pdf_text, "doc": doc_text}


def read_files(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)


def document_info(files: DataFrame) -> DataFrame:
    """File name, extension, size and whether a parser knows it."""
    return files.select(
        "path", F.regexp_extract("path", r"([^/\\]+)\z", 1).alias("filename"), extension(F.col("path")).alias("extension"), F.col("length").alias("size"), supported_format(F.col("path")).alias("supported"), "modificationTime"
    )


def upload_filter(files: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected ones with the reason."""
    reason = F.when(~extension(F.col("path")).isin(*UPLOADS), "unsupported type").when(F.col("length") > max_bytes, "too large")
    marked = files.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def parse_files(files: DataFrame, project_id, source: str | None = None, parsers: dict | None = None) -> DataFrame:
    """One document row per file. What cannot be parsed has status failed and a message; the others go on.

    Works on a batch as on a stream. title is the stem, language that of the first 2,000 signs.
    """
    known = PARSERS | (parsers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 100):  # files can be large
            texts, errors = [], []
            for parser, content in zip(b.column("parser").to_pylist(), b.column("content"), strict=True):
                text, error = None, None
                try:
                    if parser is None:
                        error = "unsupported format"
                    else:
                        text = known[parser](content.as_py())
                        error = None if text and text.strip() else "no text"
                except Exception as e:  # one bad file is one failed document
                    error = f"{type(e).__name__}: {e}"
                texts.append(text if error is None else None)
                errors.append(error)
            names = ["path", "checksum", "raw", "error_message"]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("checksum"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=names)

    rows = files.select("path", "content", parser_of(F.col("path")).alias("parser"), checksum(F.col("content")).alias("checksum"))
    parsed = rows.mapInArrow(run, "path string, checksum string, raw string, error_message string")
    text, name = clean_document(F.col("raw")), F.regexp_extract("path", r"([^/\\]+)\z", 1)
    return parsed.select(
        F.xxhash64("path").alias("doc_id"),
        F.lit(project_id).alias("project_id"),
        F.regexp_replace(name, r"\.[^.]*\z", "").alias("title"),
        name.alias("filename"),
        F.lit(source).cast("string").alias("source"),
        "checksum",
        F.when(F.col("error_message").isNull(), "completed").otherwise("failed").alias("status"),
        F.when(F.col("raw").isNotNull(), guess_language(F.col("raw"))).alias("lang"),
        F.coalesce(F.length(text), F.lit(0)).alias("char_count"),
        text.alias("text"),
        F.col("path").alias("storage_path"),
        "error_message",
    )


def read_documents(spark: SparkSession, paths: str | list[str], project_id, source: str | None = None, parsers: dict | None = None) -> DataFrame:
    return parse_files(read_files(spark, paths), project_id, source, parsers)
