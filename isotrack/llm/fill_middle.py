"""Fill-in-the-middle transformation by a sparse scan of events.

One Aho-Corasick automaton holds the ASCII characters at which a text changes
between words and white space, and the sentinels.  It runs once over a text and
reports positions; a gap between two neighbouring white-space events that is
wider than one character is exactly one unit, so units are counted, and the
end of the k-th found, from the positions alone: no list of tokens is made.

A unit is a word with the white space before it, or the white space at the end
of the text.  Hashes of the document's id choose two cuts between units, the
form and its order, so that reruns agree on any cluster.  Texts never leave
Spark's rows: the scan returns numbers, and the pieces are cut and joined as
columns.  Nothing is shuffled.

Defined results: null text is empty; an empty text, or one that holds a
sentinel, stays plain; a null id is hashed like an empty one; repeated rows are
treated alike; texts of any length are scanned whole, with nine bytes held for
each event; other columns, whatever their names, stay as they are; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

SPACES = "\t\n\v\f\r "
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED, RATE, SPM_RATE = 42, 50, 80  # of 100 documents, how many are transformed; of 100 of these, how many are spm
SCAN = "n long, first long, second long, marked boolean"
EVENT = np.dtype([("at", "i8"), ("kind", "i1")])

_AUTOMATON: list = []


def automaton():
    """White space is kind 0, a sentinel kind 1; built once a process."""
    if not _AUTOMATON:
        import ahocorasick

        found = ahocorasick.Automaton()
        for kind, names in enumerate((SPACES, (PREFIX, SUFFIX, MIDDLE))):
            for name in names:
                found.add_word(name, kind)
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def scan_text(text: str) -> tuple[np.ndarray, bool]:
    """Ends of all units, in code points, and whether a sentinel occurs."""
    events = np.fromiter(automaton().iter(text), EVENT)
    spaces = events["at"][events["kind"] == 0]
    marks = np.concatenate([[-1], spaces, [len(text)]])
    ends = marks[1:][np.diff(marks) > 1]
    if len(spaces) and spaces[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, len(spaces) < len(events)


def scan(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """For each text its number of units n, the ends of the smaller and the larger of the two ranks modulo n + 1, and whether it is marked."""
    out: list[tuple] = []
    for text, one, two in zip(texts, first.to_pylist(), second.to_pylist()):
        text = text.as_py() or ""
        ends, marked = scan_text(text)
        n = len(ends)
        ranks = sorted((one % (n + 1), two % (n + 1)))
        out.append((n, *(int(ends[r - 1]) if r else 0 for r in ranks), marked))
    columns = list(zip(*out)) if out else [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["n", "first", "second", "marked"])


def draw(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th group of eight hexadecimal digits of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with n_units, form, prefix_chars, middle_chars and output; names that are taken get an underscore.

    The names used are ``output_columns(docs)``.
    """
    n, form, prefix, middle, output = output_columns(docs)
    body, found, one, two = unused(docs, "__text", "__scan", "__one", "__two")
    run = F.arrow_udf(scan, SCAN)
    rows = docs.withColumn(body, F.coalesce("text", F.lit(""))).withColumn(one, draw(F.col("doc_id"), 0, seed)).withColumn(two, draw(F.col("doc_id"), 1, seed))
    rows = rows.withColumn(found, run(body, one, two))
    at, to, text = F.col(found)["first"], F.col(found)["second"], F.col(body)
    plain = (F.length(text) == 0) | F.col(found)["marked"] | (draw(F.col("doc_id"), 2, seed) % 100 >= rate)
    rows = rows.withColumn(form, F.when(plain, PLAIN).when(draw(F.col("doc_id"), 3, seed) % 100 < spm_rate, SPM).otherwise(PSM))
    head, inner, tail = text.substr(F.lit(1), at.cast("int")), text.substr((at + 1).cast("int"), (to - at).cast("int")), text.substr((to + 1).cast("int"), F.length(text))
    made = F.when(F.col(form) == PLAIN, text)
    made = made.when(F.col(form) == PSM, F.concat(F.lit(PREFIX), head, F.lit(SUFFIX), tail, F.lit(MIDDLE), inner))
    made = made.otherwise(F.concat(F.lit(SUFFIX), tail, F.lit(PREFIX), head, F.lit(MIDDLE), inner))
    cut = F.col(form) != PLAIN
    return rows.select(*docs.columns, F.col(found)["n"].alias(n), form, F.when(cut, at).alias(prefix), F.when(cut, to - at).alias(middle), made.alias(output))


def output_columns(docs: DataFrame) -> list[str]:
    return unused(docs, "n_units", "form", "prefix_chars", "middle_chars", "output")


def restore(output: Column, form: Column) -> Column:
    """The exact text, from the output and its form alone: a transformed text holds each sentinel once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
