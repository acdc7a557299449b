"""Chunking: fixed windows and paragraphs as expressions; sentence and header aware packing in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches

#: Korean sentence endings; otherwise . ! ? before a blank, or a line's end, ends a sentence.
ENDINGS = ("다.", "요.", "죠.", "네.", "군요.", "습니다.", "니다.", "입니다.", "ㅂ니다.", "까?", "요?", "니?", "죠?", "가요?", "나요?", "자.", "세요.", "시오.", "라.", "구나.", "군.", "네!", "요!")
SENTENCE = re.compile("|".join(map(re.escape, ENDINGS)) + r"|[.!?](?=\s|\Z)|\n")
HEADER = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
FENCE = re.compile(r"```(\w*)\n?.*?```", re.S)
FRONT = re.compile(r"\A---\r?\n.*?\r?\n---\r?\n?", re.S)
CHUNKS = "path string, chunk_index int, content string, start int, end int, header string, header_level int, section_chunk int, has_code boolean, code_languages array<string>"


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of `size` code points, each beginning size - overlap after the last; the first that reaches the end is the last."""
    n, step = F.length(text), size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    at = docs.filter(n > 0).select(id_col, text, F.posexplode(F.sequence(F.lit(0), count - 1)).alias("chunk_index", "k"))
    start = F.col("k") * step
    return at.select(id_col, "chunk_index", start.alias("start"), F.least(start + size, n).alias("end"), F.trim(F.substring(text, start + 1, F.lit(size))).alias("content"))


def paragraph_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """Pieces between separators that aren't blank, numbered."""
    parts = F.filter(F.transform(F.split(text, separator, -1), lambda x: F.trim(x)), lambda p: F.length(p) > 0)
    return docs.select(id_col, F.posexplode(parts).alias("chunk_index", "content"))


def sentences(text: str, start: int, end: int, solid: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of sentences that together cover text[start:end]; none ends within a solid span (a code block)."""
    last = start
    for m in SENTENCE.finditer(text, start, end):
        if any(a < m.end() < b for a, b in solid):
            continue
        yield last, m.end()
        last = m.end()
    if last < end:
        yield last, end


def overlap_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where a chunk's carried-over end begins: after the first sentence end within its last `overlap` code points."""
    if end - start <= overlap:
        return start
    m = re.compile(r"[.!?다요죠]\s+").search(text, end - overlap, end)
    return m.end() if m else end - overlap


def chunk_text(text: str, size: int = 1000, overlap: int = 200, by_headers: bool = True) -> list[dict]:
    """Chunks of a note with exact offsets. Front matter is left out; sections begin at headers outside code; a section
    that fits is one chunk; others are packed from whole sentences up to `size`, each chunk after the first beginning with
    the end of the one before; code blocks are never split and never carried over."""
    front = FRONT.match(text)
    begin = front.end() if front else 0
    solid = [(m.start(), m.end()) for m in FENCE.finditer(text, begin)]
    heads = [m for m in HEADER.finditer(text, begin) if not any(a <= m.start() < b for a, b in solid)] if by_headers else []
    cuts = [begin, *[m.start() for m in heads if m.start() > begin], len(text)]
    named = {m.start(): m for m in heads}
    out: list[dict] = []

    def emit(a: int, b: int, head, k: int) -> None:
        body = text[a:b]
        if body.strip():
            inner = [(x, y) for x, y in solid if x < b and y > a]
            langs = list(dict.fromkeys(m[1] for m in FENCE.finditer(body) if m[1]))
            out.append({"chunk_index": len(out), "content": body.strip(), "start": a, "end": b, "header": head[2] if head else None, "header_level": len(head[1]) if head else None, "section_chunk": k, "has_code": bool(inner), "code_languages": langs})

    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        head = named.get(a)
        if b - a <= size:
            emit(a, b, head, 0)
            continue
        start, end, k = a, a, 0
        for _, stop in sentences(text, a, b, solid):
            if stop - start > size and end > start:
                emit(start, end, head, k)
                k += 1
                carry = overlap_start(text, start, end, overlap)
                code = max((y for x, y in solid if x < end and y > carry), default=None)
                start = carry if code is None else max(carry, min(code, end))
            end = stop
        emit(start, end, head, k)
    return out


def chunk_notes(notes: DataFrame, size: int = 1000, overlap: int = 200, by_headers: bool = True) -> DataFrame:
    """Chunks (see CHUNKS) of notes with path and content."""

    def run(batches):
        for b in batches:
            rows = [{"path": p, **c} for p, t in zip(b["path"], b["content"], strict=True) for c in chunk_text(t or "", size, overlap, by_headers)]
            names = [f.split(" ")[0] for f in CHUNKS.split(", ")]
            frame = pd.DataFrame(rows, columns=names)
            frame["header_level"] = frame["header_level"].astype("Int32")
            yield frame

    bound_batches(notes.sparkSession)
    return notes.select("path", "content").mapInPandas(run, CHUNKS)


class ChunkNotes:
    """A table function for SQL: chunks (see CHUNKS) of the rows of a table with path and content, and of size and overlap.

        SELECT * FROM chunk_notes(TABLE(notes))
        SELECT * FROM chunk_notes(TABLE(notes), size => 500, overlap => 50)

    The rows are taken where they are; nothing is dealt anew unless the query says PARTITION BY.
    """

    @staticmethod
    def analyze(notes, size=None, overlap=None, by_headers=None):
        from pyspark.sql import types as X
        from pyspark.sql.udtf import AnalyzeResult

        if not notes.isTable:
            raise ValueError("chunk_notes takes a table: chunk_notes(TABLE(notes))")
        missing = {"path", "content"} - {f.name for f in notes.dataType.fields}
        if missing:
            raise ValueError(f"chunk_notes needs columns path and content; missing: {', '.join(sorted(missing))}")
        for name, arg in (("size", size), ("overlap", overlap), ("by_headers", by_headers)):
            if arg is not None and not arg.isConstantExpression:
                raise ValueError(f"{name} must be a constant")
        if size is not None and size.value <= 0 or overlap is not None and overlap.value < 0:
            raise ValueError("size must be positive, and overlap not negative")
        kinds = {"string": X.StringType(), "int": X.IntegerType(), "boolean": X.BooleanType(), "array<string>": X.ArrayType(X.StringType())}
        return AnalyzeResult(schema=X.StructType([X.StructField(name, kinds[kind]) for name, kind in (f.split(" ") for f in CHUNKS.split(", "))]))

    def eval(self, notes, size=1000, overlap=200, by_headers=True):
        for c in chunk_text(notes["content"] or "", size, overlap, by_headers):
            yield (notes["path"], *c.values())


def register(spark, name: str = "chunk_notes") -> None:
    """Makes the table function known to a session's SQL."""
    spark.udtf.register(name, F.udtf(ChunkNotes))


#: Lengths of context and headings that say nothing.
MOST_TITLE, MOST_HEADER, MOST_LEVEL, HEADER_CHUNKS = 80, 80, 3, 2
STOP_HEADERS = (
    "overview summary notes note todo todos appendix references reference intro introduction background conclusion misc miscellaneous 개요 서론 소개 배경 요약 정리 결론 참고 참고문헌 부록 메모 노트 목차 할일 概要 はじめに まとめ 結論 参考 参考文献 付録 メモ 概述 简介 引言 背景 总结 结论 附录 备注 笔记 待办"
).split() + ["할 일"]


def contextualize(chunks: DataFrame) -> DataFrame:
    """chunks (content, title, header, header_level, section_chunk) with their heading put in front of a section's first two
    chunks where it says something, and always their title."""
    low = F.trim(F.regexp_replace(F.lower("header"), r"(?U)\s+", " "))
    title = F.trim(F.regexp_replace(F.lower("title"), r"(?U)\s+", " "))
    useful = F.col("header").isNotNull() & (F.length(low) > 1) & ~low.isin(STOP_HEADERS) & (low != title) & (F.col("section_chunk") < HEADER_CHUNKS) & ~F.startswith("content", F.lit("#"))
    level = F.least(F.greatest("header_level", F.lit(2)), F.lit(MOST_LEVEL))
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
    body = F.when(useful, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), cut(F.col("header"), MOST_HEADER), F.lit("\n\n"), F.col("content"))).otherwise(F.col("content"))
    return chunks.withColumn("content", F.concat(F.lit("# "), cut(F.col("title"), MOST_TITLE), F.lit("\n\n"), body))
