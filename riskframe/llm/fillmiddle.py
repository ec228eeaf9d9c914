"""Fill-in-the-middle transformation as a pyarrow.compute pipeline.

A text is cut into units (white space with the word behind it); two cut points
drawn from a digest of the document's id part the units into prefix, middle and
suffix.  Per slice of a batch the units become a list array, which is flattened
with its parent indices; each unit's ordinal within its parent says which role
it has; the units of a role are filtered, rebuilt into one list a document and
joined.  Texts that hold a sentinel, empty texts and the share not chosen stay
plain.  Map-only: no shuffle, slices of bounded size, a long text whole.

Defined results: a null text is the empty text (plain); a null doc_id is drawn
as the empty string and passed on; repeated rows give repeated results; an
empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
END = b"\xff"                  # behind every unit: a byte that no UTF-8 text holds
SLICE = 2 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = 42) -> Column:
    """Four unsigned 32-bit draws (array of long) of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def _binary(text: pa.Array) -> pa.Array:
    return text.cast(pa.large_string()).view(pa.large_binary())


def _text(raw: pa.Array) -> pa.Array:
    return raw.view(pa.large_string())       # cut at ASCII white space only


def unit_lists(raw: pa.Array) -> pa.ListArray:
    """The units of each text, with one empty string behind the last."""
    return pc.split_pattern(pc.replace_substring_regex(raw, UNIT, rb"\0" + END), END)


def pieces(units: pa.ListArray, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: its units before ``first``, before ``second``, and the rest."""
    n = pc.subtract(pc.list_value_length(units).cast(pa.int64()), 1)
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    starts = pc.subtract(pc.cumulative_sum(pc.add(n, 1)), pc.add(n, 1))
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parent))
    bounds = [pa.array(np.zeros(len(units), np.int64)), first, second, n]
    of_unit = [pc.take(b, parent) for b in bounds]
    out = []
    for role in range(3):
        chosen = pc.and_(pc.greater_equal(ordinal, of_unit[role]), pc.less(ordinal, of_unit[role + 1]))
        ends = pc.cumulative_sum(pc.subtract(bounds[role + 1], bounds[role]))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, chosen)), pa.scalar(b"", pa.large_binary())))
    return out


def _chosen(part: pa.RecordBatch, raw: pa.Array, count: pa.Array, spm_rate: int) -> tuple[pa.Array, ...]:
    """Form, prefix and middle length, and output of rows that are transformed."""
    h = [pc.list_element(part.column("h"), i).to_numpy() for i in (0, 1, 3)]
    size = count.to_numpy() + 1
    a, b = h[0] % size, h[1] % size
    prefix, middle, suffix = (_text(x) for x in pieces(unit_lists(raw), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))))
    spm = pa.array(h[2] % 100 < spm_rate)
    text, none = pa.large_string(), pa.scalar("", pa.large_string())
    p, s, m = (pa.scalar(x, text) for x in (PREFIX, SUFFIX, MIDDLE))
    output = pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
                        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none))
    return pc.if_else(spm, "spm", "psm"), pc.utf8_length(prefix), pc.utf8_length(middle), output


def fill_in_middle(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    ``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of those with the suffix first.
    """
    d = documents(docs, id_col, text_col)
    d = d.select(d["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), draws(d["doc_id"], seed).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text = part.column("text").cast(pa.large_string())
                raw = _binary(text)
                count = pc.count_substring_regex(raw, UNIT).cast(pa.int64())
                stays = pa.array(pc.list_element(part.column("h"), 2).to_numpy() % 100 >= rate)
                stays = pc.or_(stays, pc.or_(pc.equal(count, 0), pc.match_substring_regex(text, SENTINEL)))
                moved = pc.invert(stays)
                form, prefix, middle, output = _chosen(part.filter(moved), raw.filter(moved), count.filter(moved), spm_rate)
                null = pa.nulls(len(text), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), count,
                     pc.replace_with_mask(pa.array(["plain"] * len(text)), moved, form.cast(pa.string())),
                     pc.replace_with_mask(null, moved, prefix.cast(pa.int64())), pc.replace_with_mask(null, moved, middle.cast(pa.int64())),
                     pc.replace_with_mask(text, moved, output).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return d.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output of ``fill_in_middle``, from the output and its form alone."""
    part = F.split(output, SENTINEL, -1)             # a transformed text holds each sentinel once
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
