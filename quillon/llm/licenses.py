"""License scans: an Aho-Corasick automaton finds tags and notice phrases; a shunting-yard parser reads expressions."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The base phrases and their labels, then this operator's own notice phrases.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "attribution noncommercial": "cc-by-nc",
    "attribution non commercial": "cc-by-nc",
    "attribution noderivatives": "cc-by-nd",
    "attribution no derivatives": "cc-by-nd",
    "attribution noderivs": "cc-by-nd",
    "attribution sharealike": "cc-by-sa",
    "attribution share alike": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "public domain": "public-domain",
    "boost software license": "bsl",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
#: Families that bind a text's use no further than by a notice; all others do.
PERMISSIVE = frozenset({"apache", "mit", "bsd", "cc-by", "cc0", "public-domain", "bsl", "isc", "unlicense"})

#: Lower-cases A-Z and turns every byte between words into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str) -> list[str]:
    """A licence expression in postfix order, by two stacks; with binds before and, and before or.

    Reading stops at the first token that cannot follow; brackets and an
    operator that still wait for an operand then are dropped, other brackets
    close at the end.  No expression gives an empty list.
    """
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _RANK:
            if operand_next:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            stack.append(token)
        elif token == ")":
            if operand_next or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if not operand_next:
                break
            out.append(word.rstrip(".:-"))
            operand_next = False
    while operand_next and stack:
        operand_next = stack.pop() == "("
    out += [x for x in reversed(stack) if x != "("]
    return out


#: First parts of identifiers and the label they count as.
FAMILIES = {"apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "epl": "epl", "cc0": "cc0", "isc": "isc", "bsl": "bsl", "unlicense": "unlicense", "0bsd": "bsd"}
_CLAUSES = re.compile(r"cc-by(?:-(?:nc|nd|sa))*")


def family(identifier: str) -> str:
    """The label that decides about an identifier: without version; cc-by keeps its clauses, as they bind."""
    if m := _CLAUSES.match(identifier):
        return m[0]
    return FAMILIES.get(identifier.split("-")[0], identifier)


def read_expression(expression: str, allowed: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool | None]:
    """(identifiers named, whether the expression can be met by allowed families alone; None without an expression).

    a or b: either suffices; a and b: both are needed; a with e: as a, the
    exception e is not named.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in to_postfix(expression):
        if token not in _RANK:
            stack.append(({token}, family(token) in allowed))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(left)
        else:
            stack.append((left[0] | right[0], (left[1] or right[1]) if token == "or" else (left[1] and right[1])))
    return stack[-1] if stack else (set(), None)


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE_PHRASES, TAG: None}.items():
        found.add_word(f" {phrase} ", (phrase, label, len(phrase) + 1, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive) of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_TABLE).split()
    joined = b"".join((b" ", b" ".join(words), b" ")).decode("latin-1")  # byte by byte; the phrases are ASCII
    base, labels, places, tagged, notices = set(), set(), [], False, 0
    for end, (phrase, label, back, is_base) in _automaton().iter(joined):
        if is_base:
            base.add(label)
            places.append(end - back)
        elif label is None:
            tagged = True
        else:
            labels.add(label)
            notices += 1
    permissive = None
    if tagged:
        for m in _TAG.finditer(text):
            named, ok = read_expression(m[1])
            labels |= named
            if ok is not None:
                permissive = ok if permissive is None else permissive and ok
    first = last = None
    if places:
        first, last = (joined.count(" ", 0, p) for p in (min(places), max(places)))
    labels |= base
    if permissive is None and labels:
        permissive = labels <= PERMISSIVE
    score = 1.0 if tagged and permissive is not None and labels else min(0.95, 0.5 + 0.15 * (len(places) + notices)) if labels else 0.0
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License evidence in every whole text, one row per input row.

    n_words, n_base (all places of base phrases), first_word and last_word
    (their smallest and largest start, else null), base_labels, labels (base
    and own: of notice phrases, and the identifiers of tags whole; distinct,
    sorted, comma-joined; empty without any), score (0 to 1) and permissive
    (whether the evidence can be met by permissive licences; tags decide before
    notices; null without evidence).  Very long texts are scanned whole; null texts count as empty; null ids stay null;
    repeated rows are scanned each for itself; an empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_base", T.LongType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("last_word", T.LongType()),
            T.StructField("base_labels", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("permissive", T.BooleanType()),
        ]
    )
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())

    def run(batches):
        for batch in batches:
            rows = [scan_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
