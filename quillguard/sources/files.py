"""Files as text rows: landed objects, office documents, unified diffs."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Zipped formats -> which members hold text.
MEMBERS = {
    "docx": r"word/(?:document|comments|footnotes|endnotes|header\d*|footer\d*)\.xml|docProps/\w+\.xml",
    "pptx": r"ppt/(?:slides/slide|notesSlides/notesSlide|comments/)\w*\.xml|docProps/\w+\.xml",
    "xlsx": r"xl/(?:sharedStrings|worksheets/sheet\d+|comments\d*)\.xml|docProps/\w+\.xml",
    "odt": r"(?:content|styles)\.xml", "ods": r"(?:content|styles)\.xml", "odp": r"(?:content|styles)\.xml",
}
BREAKS = {"p", "br", "tab", "row", "c", "si", "h", "table-row", "table-cell", "title", "subject", "creator", "description", "keywords"}
UNREADABLE = ("png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp", "zip", "gz", "7z", "exe", "dll", "so", "mp3", "mp4", "mov", "doc", "xls", "ppt")
UNPACKED = 64_000_000  # bytes that one file's members may unpack to; what lies beyond makes the text partial
NO_BODY = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "themedata", "datastore"}


def zipped_text(data: bytes, wanted: str) -> tuple[str, bool]:
    """Text of the members of a zipped document, and whether some of it couldn't be read."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError):
        return "", True
    out, left = [], UNPACKED
    partial = any("/embeddings/" in n for n in archive.namelist())
    for member in archive.infolist():
        if not re.fullmatch(wanted, member.filename):
            continue
        try:
            with archive.open(member) as stream:
                raw = stream.read(left + 1)
            partial, raw = partial or len(raw) > left, raw[:left]
            left -= len(raw)
            for _, element in ElementTree.iterparse(io.BytesIO(raw)):
                out.append(element.text or "")
                out.append("\n" if element.tag.rpartition("}")[2] in BREAKS else "")
                out.append(element.tail or "")
                element.clear()
        except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, OSError, RuntimeError, NotImplementedError):
            partial = True
    return "".join(out), partial


def rtf_text(data: bytes) -> tuple[str, bool]:
    """Body text of rich text: groups without a body are skipped, escapes resolved."""
    s, out, skip, stack = data.decode("latin-1"), [], False, []
    if not s.lstrip().startswith("{\\rtf"):
        return "", True
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", s, re.S):
        hexed, code, word, _, char, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif char == "*" or word in NO_BODY:
            skip = True
        elif not skip:
            out.append(bytes.fromhex(hexed).decode("cp1252", "replace") if hexed else chr(int(code) % 0x10000) if code else "\n" if word in ("par", "line", "row") else "\t" if word in ("tab", "cell") else "" if word else char if char and char in "{}\\" else plain or "")
    return "".join(out), bool(stack)


def pdf_text(data: bytes) -> tuple[str, bool]:
    """Text that a PDF's plain and deflated content streams show; other filters make the result partial."""
    out, partial, left = [], False, UNPACKED
    for m in re.finditer(rb"<<((?:(?!endobj).){0,2000}?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        head, body = m.groups()
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body, max(left, 1))
            except zlib.error:
                partial = True
                continue
        elif b"/Filter" in head:
            partial = partial or b"/Image" not in head
            continue
        left -= len(body)
        partial = partial or left <= 0
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            for literal, hexed, kern, end in re.findall(rb"\(((?:\\.|\((?:\\.|[^\\()])*\)|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>|(-\d{3,})|\b(Td|TD|T\*|Tm)(?![A-Za-z])", block, re.S):
                if hexed:
                    raw = bytes.fromhex((h := re.sub(rb"\s", b"", hexed).decode()) + "0" * (len(h) % 2))
                    out.append(raw.decode("utf-16-be", "replace") if raw[:1] == b"\0" else raw.decode("latin-1"))
                else:
                    out.append(" " if kern else "\n" if end else re.sub(r"\\(\d{1,3}|.)", lambda e: chr(int(e[1], 8) % 256) if e[1].isdigit() else {"n": "\n", "r": "\n", "t": "\t"}.get(e[1], e[1]), literal.decode("latin-1"), flags=re.S))
            out.append("\n")
    return "".join(out).strip(), partial or b"/Encrypt" in data


def text_of(name: str, data: bytes | None) -> tuple[str, str, bool]:
    """(text, how, partial) of a file by its extension: a document, a text, or '' for what nothing reads. A text is never cut.
    Empty and null content is an empty text of no kind."""
    kind = name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
    if not data or kind in UNREADABLE:
        return "", "", False
    if kind in MEMBERS or kind in ("rtf", "pdf"):
        text, partial = zipped_text(data, MEMBERS[kind]) if kind in MEMBERS else rtf_text(data) if kind == "rtf" else pdf_text(data)
        text = re.sub(r"[ \t]*\n\s*", "\n", text).strip()
        return text, "document" if text else "", partial
    if b"\0" in data[:8000]:
        return "", "", False
    return data.decode("utf-8", "replace"), "text", False


def with_text(df: DataFrame, name: str, content: str) -> DataFrame:
    """Adds text, how and partial of binary files. Each file is read by itself; a broken one gives what could be read."""
    at = [df.columns.index(name), df.columns.index(content)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [text_of(n or "", c) for n, c in zip(b.iloc[:, at[0]], b.iloc[:, at[1]])]
            yield b.assign(text=[t for t, _, _ in found], how=[h for _, h, _ in found], partial=[p for _, _, p in found])

    return df.mapInPandas(run, df.select("*", F.lit("").alias("text"), F.lit("").alias("how"), F.lit(True).alias("partial")).schema)


def objects(spark: SparkSession, path: str, most_bytes: int = 50_000_000) -> DataFrame:
    """path, length, text, how, partial of every object below a path (any file system Spark reads). Larger objects aren't
    loaded; they stay in the result as partial, without text, never as clean. Objects of no bytes have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = with_text(files.where(F.col("length") <= most_bytes).select("path", "length", "content"), "path", "content").drop("content")
    return read.unionByName(files.where(F.col("length") > most_bytes).select("path", "length", F.lit("").alias("text"), F.lit("").alias("how"), F.lit(True).alias("partial")))


def added_lines(diff: Column) -> Column:
    """array<struct<path, line, text>> of the lines that a unified diff adds, numbered as in the new file."""

    @F.pandas_udf("array<struct<path:string,line:int,text:string>>")
    def run(diffs: pd.Series) -> pd.Series:
        return pd.Series([list(_added(d or "")) for d in diffs])

    return run(diff)


def _added(diff: str) -> Iterator[dict]:
    path, line, old, new = None, 0, 0, 0  # old, new: lines of either file that the hunk still has
    for row in diff.split("\n"):
        if old <= 0 and new <= 0:
            if row.startswith("+++ "):
                path = row[4:].split("\t")[0].removeprefix("b/")
            elif h := re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", row):
                old, line, new = int(h[1] or 1), int(h[2]), int(h[3] or 1)
            continue
        if row.startswith("\\"):
            continue
        if row.startswith("+"):
            yield {"path": path, "line": line, "text": row[1:]}
        old, new, line = old - (not row.startswith("+")), new - (not row.startswith("-")), line + (not row.startswith("-"))
