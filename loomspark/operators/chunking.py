"""Texts to chunks: paragraph packing, Markdown sections, long documents with overlap.

Packing is sequential inside a text, so it runs as Python over Arrow batches, one text at a time; texts never meet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = re.compile(r"^(#{1,6})[ \t]+(.+?)\s*$", re.M)
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str) -> int:
    return ceil(len(text) / 4)


def tail_words(text: str, budget: int) -> str:
    """The last words of a text that fit a token budget, words counted one by one."""
    kept: list[str] = []
    for word in reversed(text.split()):
        budget -= tokens(word)
        if budget < 0:
            break
        kept.append(word)
    return " ".join(reversed(kept))


def tail_sentences(text: str, most: int) -> str:
    """The last whole sentences of a text that fit a number of characters."""
    kept = ""
    for sentence in reversed(SENTENCE.split(text)):
        joined = f"{sentence} {kept}".strip()
        if len(joined) > most:
            break
        kept = joined
    return kept


def packed(pieces: list[str], most: int, joint: str, size: Callable[[str], int] = tokens) -> Iterator[str]:
    """Pieces joined in order up to a size; a piece over the size stands alone."""
    held = ""
    for piece in pieces:
        joined = f"{held}{joint}{piece}" if held else piece
        if held and size(joined) > most:
            yield held
            held = piece
        else:
            held = joined
    if held:
        yield held


def free_text(text: str, most: int = 600, overlap: int = 0, whole_below: int = 0) -> list[dict]:
    """Paragraphs packed to a token budget, larger ones by sentences; each chunk with the place of its own text.

    A text shorter than ``whole_below`` is one chunk. With an overlap, a chunk begins with the last words of the one before.
    """
    if not text or not text.strip():
        return []
    if len(text) < whole_below:
        return [{"content": text.strip(), "char_offset": text.find(text.strip()), "chunk_type": "short", "parent": None}]
    pieces = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        pieces += [paragraph] if tokens(paragraph) <= most else list(packed(SENTENCE.split(paragraph), most, " "))
    out, at, before = [], 0, ""
    for own in packed(pieces, most, "\n\n"):
        found = text.find(own[:40], at)
        at = found if found >= 0 else at
        lead = tail_words(before, overlap) if overlap and before else ""
        out.append({"content": f"{lead} {own}".strip(), "char_offset": at, "chunk_type": "text", "parent": None})
        before = own
    return out


def sections(text: str) -> list[dict]:
    """Markdown sections with level, title, path of the titles above (by level) and body; what precedes has level 0."""
    out, path, at, level, title = [], [], 0, 0, None
    for m in [*HEADER.finditer(text), None]:
        body = text[at : m.start() if m else len(text)].strip()
        if body or title is not None:
            out.append({"level": level, "title": title, "path": [t for _, t in path[:-1]] if title is not None else [], "body": body, "start": at})
        if m:
            level, title, at = len(m[1]), m[2], m.end()
            path = [(k, t) for k, t in path if k < level] + [(level, title)]
    return out


def sectioned(text: str, most: int = 500) -> list[dict]:
    """Chunks of sections: deeper ones are smaller; a section's later chunks repeat its title."""
    out = []
    for s in sections(text or ""):
        limit = max(100, most - 50 * s["level"])
        pieces = []
        for p in filter(None, (p.strip() for p in re.split(r"\n\s*\n", s["body"]))):
            pieces += [p] if tokens(p) <= limit else list(packed(SENTENCE.split(p), limit, " "))
        for i, own in enumerate(packed(pieces, limit, "\n\n") if pieces else [""]):
            head = s["title"] or ""
            content = f"{head}\n{own}".strip() if head else own
            if content:
                out.append({"content": content, "char_offset": s["start"], "chunk_type": "section" if i == 0 else "section-part", "parent": " > ".join(s["path"]) or None})
    return out


def long_document(text: str, most: int = 25_000, overlap: int = 1000) -> list[dict]:
    """Sections packed to a number of characters; each chunk after the first begins with the end of the one before."""
    pieces = []
    for s in sections(text or ""):
        whole = ("#" * s["level"] + " " + s["title"] + "\n" if s["title"] else "") + s["body"]
        if len(whole) <= most:
            pieces.append(whole)
            continue
        for p in packed([x for x in re.split(r"\n\s*\n", whole) if x.strip()], most, "\n\n", len):
            pieces += [p] if len(p) <= most else list(packed(SENTENCE.split(p), most, " ", len))
    out, before = [], ""
    for own in packed([p for p in pieces if p.strip()], most, "\n\n", len):
        lead = tail_sentences(before, overlap) if before else ""
        out.append({"content": f"{lead}\n\n{own}".strip(), "char_offset": max(0, (text or "").find(own[:40])), "chunk_type": "long", "parent": None})
        before = own
    return out


def routed(text: str) -> list[dict]:
    """Sections for a text with Markdown structure, else free text."""
    return sectioned(text) if text and HEADER.search(text) else free_text(text or "", whole_below=800)


CHUNK = "chunk_index int, content string, char_offset int, chunk_type string, parent string, token_count int"


def chunked(docs: DataFrame, id_col: str, text_col: str, how: Callable[[str], list[dict]] = routed) -> DataFrame:
    """id and chunks of every text; a null or empty text has none."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for key, text in zip(b[id_col], b["text"]):
                for i, c in enumerate(how(text.as_py() or "")):
                    ids.append(key.as_py())
                    out.append((i, c["content"], c["char_offset"], c["chunk_type"], c["parent"], tokens(c["content"])))
            cols = list(zip(*out)) or [[]] * 6
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            names = [x.split()[0] for x in CHUNK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(id_col).type), *[pa.array(c, k) for c, k in zip(cols, kinds)]], [id_col, *names])

    return rows.mapInArrow(run, f"{id_col} {kind}, {CHUNK}")


def argument_chunks(args: DataFrame, key: str, index: str, fields: dict[str, str], most: int = 1200) -> DataFrame:
    """One chunk per argument: its fields with labels, joined and cut."""
    labelled = [F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in fields.items()]
    return args.select(key, F.col(index).alias("chunk_index"), F.substring(F.concat_ws("\n", *labelled), 1, most).alias("content"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.round(F.avg("token_count"), 2).alias("mean_tokens"))
