"""Chunkers whose cut points depend on earlier ones, as Arrow-batched functions."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOOKBACK = 80
# Fixed values.
MAP_TOKENS, OVERLAP_TOKENS, OVERHEAD_TOKENS = 2800, 400, 192
BLOCK_START = r"(?m)^\[(?:P_\d+|FIG(?:_SEQ)?_\d+[^\]]*)\]"
PARAGRAPH_TAG = r"\[(P_\d+)\]"
FIGURE_TAG = r"(?i)\[(FIG(?:_SEQ)?_\d+)"
LISTED_FIGURES, MOST_FIGURES = "Available figures in document: ", 40


def cut_sliding(text: str, size: int = 600, overlap: int = 100, least: int = 48) -> list[str]:
    """Windows of about ``size`` characters that end and begin at white space where they can.

    The size is held to 200..1200 and the overlap to half of it; shorter pieces than ``least`` go.
    """
    body = text.replace("\r\n", "\n").strip()
    size = max(200, min(int(size), 1200))
    overlap = max(0, min(int(overlap), size // 2))
    pieces, at = [], 0
    while at < len(body):
        stop = min(at + size, len(body))
        if stop < len(body):
            low = max(at + least, stop - LOOKBACK)
            gap = max(body.rfind(c, low, stop) for c in " \n\t")
            stop = gap if gap > at else stop
        piece = body[at:stop].strip()
        if len(piece) >= least:
            pieces.append(piece)
        if stop >= len(body):
            break
        begin = stop - overlap
        if begin > at:  # forward to the beginning of a word
            while begin < stop and not body[begin].isspace():
                begin += 1
            while begin < len(body) and body[begin].isspace():
                begin += 1
        at = begin if begin > at else stop
    return pieces


def _sliding(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([cut_sliding(t or "", s, o) for t, s, o in zip(text, size, overlap)])


def annotated_blocks(text: str) -> list[str]:
    """Blocks that begin with a paragraph's or a figure's tag at a line's start; a text without tags is one block."""
    raw = text.strip()
    starts = [m.start() for m in re.finditer(BLOCK_START, raw)]
    if not starts:
        return [raw] if raw else []
    return [b for first, end in zip(starts, [*starts[1:], len(raw)]) if (b := raw[first:end].strip())]


def _weigh(text: str) -> tuple[int, int]:
    """Cyrillic and other characters."""
    cyrillic = len(re.findall("[Ѐ-ӿ]", text))
    return cyrillic, len(text) - cyrillic


def _tokens(cyrillic: int, other: int) -> int:
    return int(cyrillic / 1.75 + other / 3.7)


def split_windows(text: str, header: str = "", most: int = MAP_TOKENS, overlap: int = OVERLAP_TOKENS, overhead: int = OVERHEAD_TOKENS) -> list[dict]:
    """Windows of whole blocks whose body and prompt overhead stay within ``most`` tokens.

    The body is the article's header, the list of its figures and the blocks, with blank
    lines between.  A block that is too large alone is a window.  The next window begins
    with the last blocks that make up at least ``overlap`` tokens, unless that is the
    whole window.
    """
    blocks = annotated_blocks(text)
    figures = list(dict.fromkeys(f.upper() for f in re.findall(FIGURE_TAG, text)))
    lead = [x for x in (header.strip(), LISTED_FIGURES + ", ".join(figures[:MOST_FIGURES]) if figures else "") if x]
    sizes = [_weigh(b) for b in blocks]
    alone = [_tokens(*s) for s in sizes]
    base = [sum(x) for x in zip((0, 0), *map(_weigh, lead))]
    out, first = [], 0
    while first < len(blocks):
        cyrillic, other, last, used = *base, first - 1, 0
        while last + 1 < len(blocks):
            c, o = cyrillic + sizes[last + 1][0], other + sizes[last + 1][1]
            total = _tokens(c, o + 2 * (len(lead) + last + 1 - first)) + overhead
            if last >= first and total > most:
                break
            cyrillic, other, last, used = c, o, last + 1, total
            if total > most:
                break
        body = blocks[first : last + 1]
        tags = lambda pattern: list(dict.fromkeys(t.upper() for b in body for t in re.findall(pattern, b)))
        out.append({"first": first, "last": last, "tokens": used, "paragraphs": ",".join(tags(PARAGRAPH_TAG)), "figures": ",".join(tags(FIGURE_TAG)), "body": "\n\n".join([*lead, *body])})
        if last + 1 >= len(blocks):
            break
        back, again = last, 0
        while back >= first and again < overlap:
            again += alone[back]
            back -= 1
        first = back + 1 if back >= first else last + 1
    return out


def _annotated(text: pd.Series, header: pd.Series) -> pd.Series:
    return pd.Series([split_windows(t or "", h or "") for t, h in zip(text, header)])


def sliding_chunks(text: Column, size: Column, overlap: Column) -> Column:
    """Chunks of a text as an array."""
    return F.pandas_udf(_sliding, "array<string>")(text, size, overlap)


def token_windows(annotated: Column, header: Column) -> Column:
    """Windows of an annotated text at the pipeline's sizes: block ranges, tokens, tags and body."""
    return F.pandas_udf(_annotated, "array<struct<first:int,last:int,tokens:int,paragraphs:string,figures:string,body:string>>")(annotated, header)


def _counted(tokenizer: str):
    def count(text: pd.Series) -> pd.Series:
        code = _library(tokenizer)
        return pd.Series([len(e.ids) for e in code.encode_batch(text.fillna("").tolist(), add_special_tokens=False)])

    return count


@lru_cache(maxsize=1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def counted_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens by a vocabulary file of the tokenizers library; ``texts.estimated_tokens`` is for where there is none."""
    return F.pandas_udf(_counted(tokenizer), "long")(text)
