"""Text of PDF files, by their content streams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\[(.*?)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*(?:Tj|'|\")|(T\*|T[dD]\b|ET\b)", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        e = m[1]
        return bytes([int(e, 8) & 255]) if e.isdigit() else _ESCAPE.get(e, e)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw[1:-1], flags=re.S).decode("latin-1")


def pdf_text(raw: bytes | None) -> str | None:
    """Text of a PDF's streams, line by line; runs of readable characters if that is next to nothing; null for other files."""
    if not raw or not raw.startswith(b"%PDF-"):
        return None
    lines = [""]
    for m in _STREAM.finditer(raw):
        body = m[1]
        try:
            body = zlib.decompressobj().decompress(body)
        except zlib.error:
            pass
        for s in _SHOW.finditer(body):
            if s[3]:
                lines.append("")
            else:
                lines[-1] += "".join(_literal(x) for x in (_STRING.findall(s[1]) if s[1] is not None else [s[2]]))
    text = "\n".join(x.strip() for x in lines if x.strip())
    if len(text) < 50:
        text = "\n".join(x.decode("ascii") for x in re.findall(rb"[\x20-\x7e]{5,}", raw)) if not text else text
    return re.sub(r"[ \t]+", " ", text).strip()


def read_pdfs(files: DataFrame) -> DataFrame:
    """(path, text) of files as Spark's binaryFile source reads them (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [pdf_text(c) for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
