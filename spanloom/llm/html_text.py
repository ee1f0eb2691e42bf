"""Main text of web pages: a chain CRF over the page's leaf blocks, decoded by Viterbi.

Features are the tags and attribute names above a block and plain properties of its text.  The model is trained
once per process on TRAINING_PAGES labelled pages made from a seed.

Null, empty and textless pages give an empty text; repeated rows are each answered; very long pages are read
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spread, table
from .crf import ChainCRF
from .html_blocks import Block, parse
from .training_pages import labelled_page

#: The bound on the labelled sample, whatever the size of the input.
TRAINING_PAGES = 700
_OPEN, _SHUT = "␂", "␃"


def features(block: Block) -> list[str]:
    """The features of a block: what stands above it and how its text looks."""
    text = block.text
    n, words = len(text), text.count(" ") + 1
    out = ["bias", f"len={min(n, 1 << 9).bit_length()}", f"link={round(4 * block.link_chars / n)}", f"last={text[-1] if text[-1] in '.!?:…' else ''}"]
    out += [f"tag={t}" for t in set(block.tags)]
    out += [f"name={t}" for t in block.names]
    out.append(f"leaf={block.tags[-1] if block.tags else ''}")
    if words < 3:
        out.append("few-words")
    if "©" in text[:200]:
        out.append("copyright")
    if block.is_hidden:
        out.append("hidden")
    return out


def sequence(blocks: list[Block]) -> list[list[str]]:
    return [features(b) for b in blocks]


def _labelled(seed: int) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a made page; marks inside the text carry the labels through the parser."""
    parts = labelled_page(seed)
    marked = "".join(m if label is None else re.sub(r"(>)([^<]*[^<\s][^<]*)(<)", lambda x: f"{x[1]}{(_SHUT, _OPEN)[label]}{x[2]}{x[3]}", m) for m, label in parts)
    blocks, labels = parse(marked), []
    for b in blocks:
        labels.append(int(_OPEN in b.text))
        b.text = b.text.replace(_OPEN, "").replace(_SHUT, "").strip() or "-"
    return sequence(blocks), labels


@lru_cache(maxsize=1)
def model(pages: int = TRAINING_PAGES) -> ChainCRF:
    return ChainCRF().fit([_labelled(seed) for seed in range(pages)])


def main_text(source: str | None, crf: ChainCRF) -> str:
    """The article's blocks joined by one space."""
    blocks = parse(source)
    return " ".join(b.text for b, label in zip(blocks, crf.decode(sequence(blocks))) if label)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``."""
    shared = pages.sparkSession.sparkContext.broadcast(model())  # a few hundred features, whatever the input

    def batches(it):
        crf = shared.value
        for b in it:
            texts = [main_text(h.as_py(), crf) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return spread(pages.select("page_id", "url", "html")).mapInArrow(batches, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir):
    """page_id, url, text and n_chars of every page."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
