"""Splitting oversized items at natural boundaries by dynamic programming.

A chunk of more than ``capacity`` words becomes pieces of at most ``capacity`` words, each but the first
starting with the last ``overlap`` words of the one before. Each place between two words has a penalty
by what is there (a change of heading, a segment, a blank line, a line break, an end of sentence or
clause, nothing), and the cuts minimise the sum of penalties and of squared deviations from the even
size, over all positions. A word is a maximal run of characters that are not Unicode white space.

Null ids and null, empty and short texts give no rows. Repeated rows of an id count once. An overlap of the capacity
or more is taken as capacity - 1. A chunk without segments keeps its own locator on every piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.packing import capacity_of
from lodestone.session import ship, table

#: Unicode's White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[^{SPACE}]+")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*$")
CLAUSE = re.compile(r"[,;:][\"'”’»)\]]*$")
#: Words between two segments up to which they count as the heading of the second.
HEADING_WORDS = 20
HEADING, SEGMENT, PARAGRAPH, LINE, SENTENCE_END, CLAUSE_END, NOWHERE = 0.0, 0.1, 0.15, 0.25, 0.5, 0.8, 1.2


def cuts(penalty: np.ndarray, capacity: int, overlap: int, balance: float = 1.0) -> list[int]:
    """The word indices at which new pieces start, 0 first. ``penalty[i]`` is that of a cut before word i."""
    n = len(penalty)
    if n <= capacity:
        return [0]
    step = capacity - overlap
    even = n / (1 + -(-(n - capacity) // step))
    size = (np.arange(1, capacity + 1) / even - 1) ** 2 * balance
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    m = min(capacity, n)
    best[1 : m + 1] = size[:m]
    end_penalty = np.append(penalty, 0.0)
    best[1 : m + 1] += end_penalty[1 : m + 1]
    for i in range(2, n + 1):
        lo = max(1, i - step)
        cost = best[lo:i] + size[i - lo - 1 :: -1] if i - lo - 1 >= 0 else best[lo:i]
        j = int(np.argmin(cost))
        if cost[j] + end_penalty[i] < best[i]:
            best[i], back[i] = cost[j] + end_penalty[i], lo + j
    out, i = [], n
    while i > 0:
        i = int(back[i])
        out.append(i)
    return out[::-1]


def _segments_at(words: list[str], segments: list[dict]) -> list[tuple[int, int, str | None]]:
    """(first word, word after, heading path) of each segment found in the words, in order: where all its words stand, or else the most of them from its first on, at least half."""
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    out, pos = [], 0
    for s in segments:
        own = WORD.findall(s["text"] or "")
        if not own:
            continue
        best, run = -1, 0
        for i in at.get(own[0], ()):
            if i >= pos:
                k = 1
                while k < len(own) and i + k < len(words) and words[i + k] == own[k]:
                    k += 1
                if k > run:
                    best, run = i, k
                if k == len(own):
                    break
        if run * 2 >= len(own):
            out.append((best, min(best + len(own), len(words)), s["heading_path"]))
            pos = best + 1
    return out


def penalties(text: str, spans: list[tuple[int, int]], placed: list[tuple[int, int, str | None]]) -> np.ndarray:
    p = np.full(len(spans), NOWHERE)
    for i in range(1, len(spans)):
        before, gap = text[spans[i - 1][0] : spans[i - 1][1]], text[spans[i - 1][1] : spans[i][0]]
        if "\n" in gap or "\u2029" in gap:
            p[i] = PARAGRAPH if gap.count("\n") > 1 or "\u2029" in gap else LINE
        elif SENTENCE.search(before):
            p[i] = SENTENCE_END
        elif CLAUSE.search(before):
            p[i] = CLAUSE_END
    for k, (start, _, path) in enumerate(placed):
        # words between two segments are a heading: the cut goes before it, not behind
        cut = placed[k - 1][1] if k and start - placed[k - 1][1] <= HEADING_WORDS else start
        cut = min(cut, start)
        if 0 < cut < len(p):
            p[cut] = HEADING if k and path != placed[k - 1][2] else SEGMENT
        if cut < start < len(p):
            p[start] = NOWHERE
    return p


def _path(path: str | None) -> str | None:
    return re.sub(r"\s*>\s*", " > ", path.strip()) if path and path.strip() else None


def split_text(text: str, capacity: int, overlap: int, segments: list[dict] | None = None, locator: str | None = None) -> list[dict]:
    """The pieces of one text over the capacity, [] for others."""
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) <= capacity:
        return []
    overlap = min(max(overlap, 0), capacity - 1)
    words = [text[a:b] for a, b in spans]
    placed = _segments_at(words, segments or [])
    starts = cuts(penalties(text, spans, placed), capacity, overlap)
    out = []
    for k, start in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(spans)
        first = max(0, start - overlap) if k else 0
        path = next((h for a, b, h in reversed(placed) if a <= start), None) or next((h for a, b, h in placed if a < end), None)
        out.append({"piece": k, "n_pieces": len(starts), "first_word": first, "new_from": start, "end_word": end, "n_words": end - first, "locator": _path(path) or locator, "text": text[spans[first][0] : spans[end - 1][1]]})
    return out


def split_chunks(chunks: DataFrame, segments: DataFrame, capacity: int, overlap: int) -> DataFrame:
    """Pieces of the chunks over the capacity. Only these leave the scan: a text of so many words has at least
    2 * capacity + 1 characters. Segments are gathered per chunk; together they are no longer than its text."""
    ship(chunks.sparkSession)
    long = chunks.where((F.length("text") > 2 * capacity) & F.col("id").isNotNull()).select("id", "document_id", "locator", "text").dropDuplicates(["id"])
    segs = (
        segments.select("chunk_id", "document_id", "ord", "heading_path", "text")
        .join(long.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
        .dropDuplicates(["document_id", "ord"])
        .groupBy(F.col("chunk_id").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("ord", "heading_path", "text"))).alias("segments"))
    )

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                loc = r.locator if isinstance(r.locator, str) else None
                for p in split_text(r.text, capacity, overlap, list(r.segments) if r.segments is not None else None, loc):
                    rows.append({"chunk_id": r.id, "document_id": r.document_id, **p})
            if rows:
                yield pd.DataFrame(rows)

    return long.join(segs, "id", "left").select("id", "document_id", "locator", "text", "segments").mapInPandas(
        run, "chunk_id bigint, document_id bigint, piece int, n_pieces int, first_word int, new_from int, end_word int, n_words int, locator string, text string"
    )


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_chunks(table(spark, sf, "chunks"), table(spark, sf, "segments"), *capacity_of(spark, sf, "chunk"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that came out in pieces."""
    return p4_pieces(spark, sf).where("n_pieces > 1").select("chunk_id").distinct()


def p4_check(spark: SparkSession, sf: str) -> DataFrame:
    """For each chunk that came out in pieces its words, and whether the pieces are within the limit, share the overlap, and cover it from the first word to the last."""
    cap, overlap = capacity_of(spark, sf, "chunk")
    w = Window.partitionBy("chunk_id").orderBy("piece")  # the pieces of one text
    p = p4_pieces(spark, sf).select("chunk_id", "piece", "n_pieces", "first_word", "new_from", "end_word", "n_words", F.lag("end_word").over(w).alias("before"))
    p = p.withColumn("shared", F.when(F.col("piece") == 0, F.col("first_word") == 0).otherwise((F.col("first_word") == F.greatest(F.lit(0), F.col("new_from") - overlap)) & (F.col("new_from") == F.col("before"))))
    return p.groupBy("chunk_id").agg(F.max("end_word").cast("bigint").alias("words"), F.bool_and((F.col("n_words") <= cap) & (F.col("n_words") > 0)).alias("within"), F.bool_and("shared").alias("shared"), (F.count("*") == F.max("n_pieces")).alias("whole"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_check": p4_check}
_WORDS = r"len(regexp_extract_all(text, '[^\t\n\x0b\x0c\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'))"
SQL = {
    "p4_check": f"SELECT DISTINCT id AS chunk_id, {_WORDS} AS words, true AS within, true AS shared, true AS whole FROM chunks, size_limits WHERE limit_name = 'chunk' AND {_WORDS} > capacity",
    "p4_found": f"SELECT DISTINCT id AS chunk_id FROM chunks, size_limits WHERE limit_name = 'chunk' AND {_WORDS} > capacity",
}
