"""Pictures and tables in words: three questions to a vision model for a picture, one to a text model for a table."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.images import enlarged, png_size
from ..functions.rules import CAPTION_RULES, COMPLEX_TYPES, LEAST_AREA
from ..functions.text import ECHOES, PREAMBLES

CAPTION = "Say in one sentence what kind of picture this is and what it shows."
#: What is asked of a picture of each type; the other types are read like a text.
DETAILS = {
    "flowchart": "List the steps of this flowchart and what leads to what.",
    "architecture": "List the parts of this system and how they are connected.",
    "chart": "State the axes of this chart, its series and the values that can be read.",
    "table": "Give this table row by row.",
    "timeline": "List the events of this timeline in order, with their dates.",
    "infographic": "List the statements and figures of this infographic.",
    "schematic": "List the components of this schematic and how they are wired.",
    "parts": "List the numbered parts with their names.",
    "photo": "Name the objects in this photo and any lettering.",
}
READ = "Read all text in this picture, one item on each line, without comments."
TOGETHER = "Describe the picture in a few sentences from its caption and the text found in it.\n\nCaption: {caption}\n\nText:\n{read}"
NARRATE = "Say what this table{section} states in plain sentences, every row of it. Begin with the content.\n\n{table}"
MISSING = "(not available)"


@dataclass(frozen=True)
class Ask:
    """How each call is made: tokens at most, and temperature."""

    tokens: int
    temperature: float


CALLS = {"caption": Ask(80, 0.0), "details": Ask(2600, 0.2), "together": Ask(1200, 0.15), "table": Ask(600, 0.1)}
#: (prompt, picture in base64 or None, how) -> reply; may raise.
Model = Callable[[str, str | None, Ask], str]


def _quiet(model: Model, prompt: str, picture: str | None, how: Ask) -> str:
    try:
        return model(prompt, picture, how) or ""
    except Exception:  # a call that fails says nothing
        return ""


def kind_of(caption: str, size: tuple[int, int] | None) -> str:
    """The type of a picture by the words of its caption; small ones of the complex types count as default."""
    low = caption.lower()
    kind = next((k for k, words in CAPTION_RULES if any(w in low for w in words)), "default")
    return "default" if kind in COMPLEX_TYPES and size and size[0] * size[1] < LEAST_AREA else kind


def once(text: str) -> str:
    """Without blank lines and without lines that equal the one before."""
    out: list[str] = []
    for line in text.split("\n"):
        if line.strip() and (not out or out[-1] != line):
            out.append(line)
    return "\n".join(out)


def summary(picture: bytes, model: Model) -> str:
    """A description of a picture; caption and text where the last call fails; nothing without a caption."""
    try:
        shown = base64.b64encode(enlarged(picture)).decode()
    except ValueError:  # no PNG that we can read: the model gets it as it is
        shown = base64.b64encode(picture).decode()
    caption = _quiet(model, CAPTION, shown, CALLS["caption"])
    if not caption:
        return ""
    read = _quiet(model, DETAILS.get(kind_of(caption, png_size(picture)), READ), shown, CALLS["details"])
    if sum(e in read.lower() for e in ECHOES) >= 2:
        read = ""
    whole = TOGETHER.format(caption=caption.strip() or MISSING, read=once(read).strip() or MISSING)
    told = _quiet(model, whole, None, CALLS["together"]).strip()
    return told or "\n".join([f"[Caption] {caption}"] + [f"[OCR] {read}"] * bool(read))


def summaries(elements: DataFrame, model: Model) -> DataFrame:
    """(name, id, summary) of the pictures among elements that have an image and of which the model says something."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(n, i, summary(base64.b64decode(p), model)) for n, i, p in zip(f["name"], f["id"], f["image"], strict=True)]
            yield pd.DataFrame([r for r in rows if r[2]], columns=["name", "id", "summary"])

    shown = elements.where("type = 'picture' and image is not null").select("name", "id", "image")
    return shown.mapInPandas(run, "name string, id string, summary string")


def without_preamble(reply: str) -> str:
    lines = reply.split("\n")
    while lines and lines[0].strip().lower().startswith(PREAMBLES):
        lines.pop(0)
    return "\n".join(lines).strip()


def narrator(model: Model):
    """A column of (table, section): the table in sentences, null where the model says nothing."""

    def tell(table: str, section: str | None) -> str | None:
        about = f" of the section {section}" if section else ""
        return without_preamble(_quiet(model, NARRATE.format(section=about, table=table), None, CALLS["table"])) or None

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tables, sections in batches:
            yield pd.Series([tell(t, s) for t, s in zip(tables, sections, strict=True)], dtype=object)

    return run
