"""Licence scan: Aho-Corasick phrases, and licence expressions by shunting-yard.

A text is brought to its words (letters, digits and everything beyond ASCII; A-Z
in lower case) with single blanks between, and one automaton finds all phrases
and identifier tags at word boundaries, overlapping ones included.  Where it meets
a tag, even one whose words stand on several lines, the rest of the original line
after the tag's last word is read as a licence expression: operators or, and and
with (rising in strength), parentheses and identifiers, by shunting-yard.  An
expression is valid if its operands are known licences, in lower case and with or
without a final ``+``, or own ones (LicenseRef-), and each ``with`` joins one
licence to one known exception.

Results per document: places of base phrases with the first and last start, base
labels, all labels (base, the further phrases' and identifiers of valid
expressions), the expressions in normal form, whether they are permissive, and a
score: 1 for a valid expression, 0.8 for a base phrase, 0.6 for a further phrase
alone, 0.3 for a tag without a valid expression, else 0.

Edge cases: null and empty texts have no words and no labels; a tag with an
invalid expression adds no label; equal phrases and repeated rows count each
time, and labels are sorted, so ties don't matter.  A null doc_id is carried.  An
empty table gives no rows.  Whole texts are read, whatever their length; only
doc_id and text are, whatever else there is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kilnwork.llm.textblocks import released

#: The contract's phrases and labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases of this operator.
FURTHER = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "isc license": "isc",
    "the unlicense": "unlicense",
}
#: Identifiers of licences that an expression may name, in lower case (fixed values).
LICENCES = frozenset("""
    0bsd afl-3.0 agpl-1.0-only agpl-1.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0 apsl-2.0
    artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause
    bsl-1.0 bzip2-1.0.6 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0
    cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.2-only gfdl-1.2-or-later gfdl-1.3-only
    gfdl-1.3-or-later gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd icu
    ijg ipl-1.0 isc json lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only
    lgpl-3.0-or-later libpng libtiff mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl ncsa odbl-1.0 ofl-1.0 ofl-1.1 openssl osl-3.0 php-3.0
    php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl
    x11 zlib zpl-2.1
""".split())
#: Identifiers of exceptions, in lower case (fixed values).
EXCEPTIONS = frozenset("""
    autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0
    gcc-exception-2.0 gcc-exception-3.1 libtool-exception linux-syscall-note llvm-exception mif-exception ocaml-lgpl-linking-exception
    openvpn-openssl-exception qt-gpl-exception-1.0 qt-lgpl-exception-1.1 u-boot-exception-2.0 wxwindows-exception-3.1
""".split())
TAG = "spdx license identifier"
#: Families whose licences allow closed reuse; for ``permissive``.
PERMISSIVE = ("apache", "mit", "bsd", "isc", "cc-by", "cc0", "unlicense", "zlib", "0bsd")
SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, permissive boolean, score double"

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
_LEAD = re.compile(r"^[^\w\n(]*")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, by shunting-yard; None if it isn't valid.

    Operators bind with > and > or, and are read in any case.  Trailing
    punctuation and comment ends are ignored.
    """
    text = re.sub(r"(\*/|-->|[\s.,;\"'`>])+$", "", expression.strip())
    out: list[str] = []
    stack: list[str] = []
    at, operand_next = 0, True
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            return None
        token, at = found[1], found.end()
        low = token.lower()
        if token == "(":
            if not operand_next:
                return None
            stack.append(token)
        elif token == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _STRENGTH:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(low)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(code: list[str]) -> tuple[set[str], bool, str]:
    """Identifiers, whether the licence is permissive, and the expression with all parentheses."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in code:
        if token not in _STRENGTH:
            stack.append(({token}, any(token == p or token.startswith(p + "-") for p in PERMISSIVE), token))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":  # an exception only ever grants more; it is no licence of its own
            stack.append((a[0], a[1], f"({a[2]} with {b[2]})"))
        else:
            stack.append((a[0] | b[0], a[1] and b[1] if token == "and" else a[1] or b[1], f"({a[2]} {token} {b[2]})"))
    return stack[0]


def valid(code: list[str]) -> bool:
    """Whether the operands of an expression in postfix order are known, and exceptions stand where they may."""
    stack: list[str] = []  # kinds of operands: licence, exception, compound
    for token in code:
        if token not in _STRENGTH:
            licence = token.removesuffix("+") in LICENCES or re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", token)
            stack.append("licence" if licence else "exception" if token in EXCEPTIONS else "unknown")
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            fits = left == "licence" and right == "exception"
        else:
            fits = left in ("licence", "compound") and right in ("licence", "compound")
        stack.append("compound" if fits else "unknown")
    return stack in (["licence"], ["compound"])


def expressions(raw: bytes, words: list[int]) -> Iterator[str]:
    """What follows each of the words, given by number, up to the line's end."""
    wanted = set(words)
    for k, found in enumerate(_WORD.finditer(raw)):
        if k in wanted:
            stop = raw.find(b"\n", found.end())
            rest = raw[found.end() : stop if stop >= 0 else len(raw)]
            yield _LEAD.sub("", rest.decode("utf-8", "surrogatepass"))


_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for phrase, label in FURTHER.items():
            _automaton.add_word(f" {phrase} ", ("further", label, len(phrase)))
        for phrase, label in BASE.items():
            _automaton.add_word(f" {phrase} ", ("base", label, len(phrase)))
        _automaton.add_word(f" {TAG} ", ("tag", "", len(TAG)))
        _automaton.make_automaton()
    return _automaton


def scan_text(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORD_BYTES).split()
    plain = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts, base, further, tags = [], set(), set(), []
    for end, (kind, label, length) in automaton().iter(plain):
        if kind == "base":
            starts.append(end - length - 1)
            base.add(label)
        elif kind == "further":
            further.add(label)
        else:
            tags.append(end)
    first = last = None
    if starts:
        first = plain.count(" ", 0, min(starts) + 1) - 1
        last = plain.count(" ", 0, max(starts) + 1) - 1
    forms, permissive = [], None
    if tags:
        for expression in expressions(raw, [plain.count(" ", 0, end) - 1 for end in tags]):
            code = postfix(expression)
            if code is not None and valid(code):
                names, free, form = evaluate(code)
                further |= names
                forms.append(form)
                permissive = free if permissive is None else permissive and free
    score = 1.0 if forms else 0.8 if base else 0.6 if further else 0.3 if tags else 0.0
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | further)), forms, permissive, score


def scan(docs: DataFrame) -> DataFrame:
    """One row per document; see the module's text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.float64()]
    names = [x.split()[0] for x in SCAN.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(x.as_py()) for x in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(work), SCAN)


