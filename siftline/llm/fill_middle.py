"""Fill-in-the-middle transformation of whole texts in one Arrow-batched pass.

A text is cut into units (a run of letters A-Z, or any other single character). The ``regex`` library's finditer walks
over it once and the units' end offsets go into a compact array of four bytes each; prefix and middle end after two
unit counts that a seed of the document picks, so two look-ups in the array give the offsets that slice the text. Seeds
and digests come from hashlib, so they depend on the id alone and reruns, retries and other layouts agree.

The form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); each part follows its own mark. A text
that holds a mark stays plain, and marks neither begin nor end alike, so each mark occurs exactly once in an output and
``restored`` finds the text again from output and form alone.

Scale. One pass over the rows, nothing shuffles, and a task holds one Arrow batch of texts at a time; Spark bounds
a batch by rows and bytes. A unit takes four bytes beside its text while that text is being cut.

Defined cases. A null text counts as empty; an empty text is plain and has no units. A null id seeds like the empty
id. Rows that repeat get the same output each. An empty table gives an empty result. ``transformed`` carries all other
columns along; those named like its own are replaced.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import in_row, packed, table
from siftline.llm.memory import give_back

UNIT = "[A-Za-z]+|[^A-Za-z]"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Spec:
    """Marks of the parts, how many of 100 texts are transformed, how many of 100 of those put the suffix first, and the seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    of_100: int = 90
    suffix_first: int = 20
    seed: str = "1"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def numbers(seed: str, doc_id: object) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 that the seed and the id give."""
    shown = "" if doc_id is None or pd.isna(doc_id) else str(int(doc_id))
    digest = hashlib.sha256(f"{seed}:{shown}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12))


def ends_of_units(text: str, units: regex.Pattern) -> array:
    """Where each unit of a text ends."""
    return array("I", [m.end() for m in units.finditer(text)])


def transform(doc_id: object, text: str, units: regex.Pattern, spec: Spec) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and of middle (none if plain), and the output."""
    ends = ends_of_units(text, units)
    n = len(ends)
    h1, h2, h3, h4 = numbers(spec.seed, doc_id)
    if not n or h3 % 100 >= spec.of_100 or any(mark in text for mark in spec.marks):
        return n, PLAIN, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[first - 1] if first else 0), (ends[second - 1] if second else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spec.suffix_first:
        return n, SPM, a, b - a, "".join((spec.suffix, suffix, spec.prefix, prefix, spec.middle, middle))
    return n, PSM, a, b - a, "".join((spec.prefix, prefix, spec.suffix, suffix, spec.middle, middle))


def restore(output: str, form: str, spec: Spec) -> str:
    """The text that ``transform`` was given."""
    if form == PLAIN:
        return output
    one, two = (spec.prefix, spec.suffix) if form == PSM else (spec.suffix, spec.prefix)
    first, _, rest = output.removeprefix(one).partition(two)
    second, _, middle = rest.partition(spec.middle)
    prefix, suffix = (first, second) if form == PSM else (second, first)
    return "".join((prefix, middle, suffix))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


PARTS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def parts(doc_id: Column, text: Column, spec: Spec = Spec()) -> Column:
    """A struct of PARTS for each row; text must not be null."""

    @F.pandas_udf(PARTS)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        units = regex.compile(UNIT)
        for ids, texts in batches:
            rows = [(*(made := transform(i, t, units, spec)), _sha256(made[-1])) for i, t in zip(ids.tolist(), texts)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
            give_back()

    return cut(doc_id, text)


def restored(output: Column, form: Column, spec: Spec = Spec()) -> Column:
    """The text of each row, from its output and form alone."""

    @F.pandas_udf("string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([restore(o, f, spec) for o, f in zip(outputs, forms)], dtype=object)

    return back(output, form)


def restored_sha256(output: Column, form: Column, spec: Spec = Spec()) -> Column:
    """SHA-256 of that text; the text itself doesn't leave the worker."""

    @F.pandas_udf("string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([_sha256(restore(o, f, spec)) for o, f in zip(outputs, forms)], dtype=object)
            give_back()

    return back(output, form)


def transformed(docs: DataFrame, spec: Spec = Spec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars, output and output_sha256."""
    own = [part.split()[0] for part in PARTS.split(", ")]
    made = packed(docs).withColumn("made", parts(in_row(id_col).cast("long"), F.coalesce(in_row(text_col), F.lit("")), spec))
    return made.select(*[in_row(c).alias(c) for c in docs.columns if c not in own], "made.*")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    rows = rows.withColumn("restored_sha256", restored_sha256(F.col("output"), F.col("form")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
