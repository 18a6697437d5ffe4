"""Identities: hashes of names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def node_key(name: Column, kind: Column) -> Column:
    return F.concat(F.lower(strip(name)), F.lit("::"), F.lower(strip(kind)))


def node_id(name: Column, kind: Column) -> Column:
    return F.substring(F.sha2(F.concat(strip(F.lower(name)), F.lit("::"), strip(F.lower(kind))), 256), 1, 16)


def triple_id(method: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", method, subject, predicate, obj), 256), 1, 24)
