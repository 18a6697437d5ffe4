"""Rule tables: captions, chunk types, relations, entity types, table sizes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a caption and the image type they mean; the first that fits counts.
CAPTION_RULES = (
    ("flowchart", ("flowchart", "flow chart", "flow diagram", "process diagram", "workflow")),
    ("architecture", ("architecture", "system diagram", "network diagram", "service diagram", "component diagram")),
    ("parts", ("parts", "assembly", "exploded")),
    ("infographic", ("infographic",)),
    ("chart", ("bar chart", "line chart", "pie chart", "histogram", "scatter plot", "chart", "graph")),
    ("schematic", ("schematic", "circuit", "wiring diagram", "electrical diagram")),
    ("logo", ("logo", "brand mark", "brand logo")),
    ("badge", ("certification badge", "rating badge", "badge", "certification", "seal", "stamp")),
    ("photo", ("product photo", "photograph", "photo", "product image")),
)
#: Image types that need a picture of some size.
COMPLEX_TYPES, LEAST_AREA = ("flowchart", "architecture", "chart", "table", "timeline", "infographic", "schematic"), 50_000
#: Closed lists of the graph.
ENTITY_TYPES = ("Person", "Organization", "Location", "Date", "Event", "Concept", "Device", "Component", "Specification", "Protocol", "Interface", "Software", "Standard", "Error", "Configuration", "Product", "Version", "Vendor", "Other")
RELATION_TYPES = ("is_a", "part_of", "causes", "governs", "opposes", "related_to", "supports_protocol", "certified_by")
#: The relation that the lemma of a verb means; any other verb relates.
RELATION_OF_VERB = {
    "be": "is_a", "represent": "is_a", "define": "is_a", "describe": "is_a", "classify": "is_a",
    "contain": "part_of", "include": "part_of", "comprise": "part_of", "consist": "part_of", "embed": "part_of", "integrate": "part_of",
    "cause": "causes", "trigger": "causes", "generate": "causes", "produce": "causes", "lead": "causes", "result": "causes", "create": "causes",
    "govern": "governs", "control": "governs", "manage": "governs", "regulate": "governs", "handle": "governs", "operate": "governs", "oversee": "governs",
    "support": "supports_protocol", "implement": "supports_protocol", "use": "supports_protocol", "utilize": "supports_protocol", "communicate": "supports_protocol",
    "certify": "certified_by", "comply": "certified_by", "conform": "certified_by", "meet": "certified_by", "satisfy": "certified_by",
    "oppose": "opposes", "conflict": "opposes", "contradict": "opposes", "prevent": "opposes",
    "connect": "related_to", "link": "related_to", "associate": "related_to", "relate": "related_to", "measure": "related_to", "detect": "related_to", "monitor": "related_to", "transmit": "related_to", "receive": "related_to", "send": "related_to", "convert": "related_to", "provide": "related_to",
}
#: The entity type that the label of a recogniser means; any other is Other.
TYPE_OF_LABEL = {
    "PERSON": "Person", "PER": "Person",
    "ORG": "Organization", "NORP": "Organization",
    "GPE": "Location", "LOC": "Location", "FAC": "Location",
    "DATE": "Date", "TIME": "Date",
    "EVENT": "Event",
    "PRODUCT": "Product",
    "WORK_OF_ART": "Concept",
    "LAW": "Standard", "STANDARD": "Standard",
    "LANGUAGE": "Software", "SOFTWARE": "Software",
    "DEVICE": "Device",
    "COMPONENT": "Component",
    "PROTOCOL": "Protocol",
    "ERROR": "Error",
    "VERSION": "Version",
    "VENDOR": "Vendor",
    "INTERFACE": "Interface",
    "CONFIGURATION": "Configuration",
    "SPECIFICATION": "Specification",
}
#: Labels that are no entities.
SKIPPED_LABELS = ("CARDINAL", "ORDINAL", "QUANTITY", "MONEY", "PERCENT")


def caption_type(caption: Column) -> Column:
    low, out = F.lower(caption), None
    for kind, found in CAPTION_RULES:
        fits = F.lit(False)
        for w in found:
            fits = fits | low.contains(w)
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("default")


def size_guard(kind: Column, width: Column, height: Column) -> Column:
    return F.when(kind.isin(*COMPLEX_TYPES) & (width * height < LEAST_AREA), "default").otherwise(kind)


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*map(F.lit, chain.from_iterable(table.items())))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def relation_of(lemma: Column) -> Column:
    return lookup(F.lower(lemma), RELATION_OF_VERB, "related_to")


def entity_type_of(label: Column) -> Column:
    return lookup(label, TYPE_OF_LABEL, "Other")


def difficulty(rows: Column, cols: Column) -> Column:
    return F.when((cols >= 7) | (rows >= 16), "HARD").when((cols >= 4) | (rows >= 9), "MEDIUM").otherwise("EASY")


def preliminary_type(element_type: Column, ordered: Column) -> Column:
    return F.when(element_type == "picture", "picture").when((element_type == "list_item") & F.coalesce(ordered, F.lit(False)), "procedure_step").otherwise("text")


def clamp(confidence: Column) -> Column:
    return F.least(F.greatest(F.coalesce(confidence, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
