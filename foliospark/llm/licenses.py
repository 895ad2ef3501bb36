"""License scan.

One Aho-Corasick automaton finds the words of notice phrases and of identifier
tags in a text reduced to its words. Where a tag is found, the licence
expression behind it is read by a shunting-yard parser and evaluated: `or` takes
the more permissive side, `and` the less permissive, `with` relaxes its licence.

Rows are scanned one by one in Arrow batches; nothing is shuffled.

Defined cases
  null or empty text    no words, no places, empty labels, score 0
  unknown identifier    no label; permissive to degree 0 in its expression
  very long text        scanned whole, in time linear in its length
  malformed expression  its known identifiers become labels; it doesn't change the score
  repeated rows, ties   scanned alike
  empty table           empty result
  clashing columns      a column of the input with the name of an output column is replaced
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Phrases that the contract names.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Wordings of common notices, and their labels.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: Published licence identifiers, as (names, label, how permissive); {} stands for each of the versions.
LICENSES = [
    ("mit mit-0 mit-cmu mit-feh mit-modern-variant mit-advertising mit-open-group mitnfa x11 expat", "", "mit", 1.0),
    ("apache-{}", "1.0 1.1", "apache", 0.9),
    ("apache-{}", "2.0 2", "apache-2", 1.0),
    ("0bsd", "", "0bsd", 1.0),
    ("bsd-1-clause bsd-4-clause bsd-4-clause-uc bsd-4-clause-shortened bsd-protection bsd-source-code bsd-2-clause-patent bsd-2-clause-views", "", "bsd", 1.0),
    ("bsd-2-clause bsd-2-clause-freebsd bsd-2-clause-netbsd", "", "bsd-2-clause", 1.0),
    ("bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-3-clause-attribution bsd-3-clause-modification bsd-3-clause-open-mpi", "", "bsd-3-clause", 1.0),
    ("isc", "", "isc", 1.0),
    ("cc0-1.0", "", "cc0", 1.0),
    ("unlicense wtfpl cc-pddc pddl-1.0 saxpath libpng-2.0 blessing nist-pd nist-pd-fallback", "", "public-domain", 1.0),
    ("zlib zlib-acknowledgement libpng", "", "zlib", 1.0),
    ("bsl-1.0", "", "boost", 1.0),
    ("python-2.0 psf-2.0 cnri-python", "", "psf", 1.0),
    ("php-3.0 php-3.01", "", "php", 0.9),
    ("postgresql ntp hpnd curl icu unicode-dfs-2015 unicode-dfs-2016 unicode-3.0 unicode-tou ncsa naist-2003 intel info-zip ijg ftl fair bzip2-1.0.6 blueoak-1.0.0 afl-3.0 ecl-2.0 w3c xnet upl-1.0 vim zpl-2.0 zpl-2.1 openssl ssh-openssh tcl beerware ms-pl", "", "permissive", 1.0),
    ("cc-by-{}", "1.0 2.0 2.5 3.0 4.0", "cc-by", 0.9),
    ("cc-by-sa-{}", "1.0 2.0 2.5 3.0 4.0", "cc-by-sa", 0.5),
    ("cc-by-nd-{}", "1.0 2.0 2.5 3.0 4.0", "cc-by-nd", 0.1),
    ("cc-by-nc-{}", "1.0 2.0 2.5 3.0 4.0", "cc-by-nc", 0.1),
    ("cc-by-nc-sa-{}", "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-sa", 0.1),
    ("cc-by-nc-nd-{}", "1.0 2.0 2.5 3.0 4.0", "cc-by-nc-nd", 0.05),
    ("mpl-{} mpl-2.0-no-copyleft-exception", "1.0 1.1 2.0", "mpl", 0.6),
    ("epl-{}", "1.0 2.0", "epl", 0.6),
    ("eupl-{}", "1.0 1.1 1.2", "eupl", 0.5),
    ("cddl-{}", "1.0 1.1", "cddl", 0.6),
    ("cpl-1.0 ipl-1.0 apsl-2.0 ms-rl artistic-1.0 artistic-1.0-perl artistic-2.0 ofl-1.0 ofl-1.1 osl-3.0 qpl-1.0 sleepycat odbl-1.0", "", "copyleft", 0.5),
    ("lgpl-{}", "2.0 2.1 3.0", "lgpl", 0.5),
    ("gpl-{}", "1.0", "gpl", 0.3),
    ("gpl-{}", "2.0", "gpl-2", 0.3),
    ("gpl-{}", "3.0", "gpl-3", 0.3),
    ("gfdl-{}", "1.1 1.2 1.3", "gfdl", 0.4),
    ("agpl-{}", "1.0 3.0", "agpl", 0.2),
    ("sspl-1.0 busl-1.1 elastic-2.0 json polyform-noncommercial-1.0.0 polyform-small-business-1.0.0", "", "restricted", 0.1),
]
#: Names of published licences of many versions, as (names, label, how permissive); any version follows a name.
FAMILIES = [
    ("afl ecl mulanpsl lppl naist ogl-uk oldap php w3c zpl python unicode cecill-b etalab", "permissive", 1.0),
    ("apl apsl artistic cal cecill cecill-c cern-ohl cpal cua-opl frameworx liliq-p liliq-r liliq-rplus nasa nosl nposl oclc ofl osl qpl rpl rpsl rscpl sissl spl odbl ms-rl", "copyleft", 0.5),
    ("nlod odc-by", "permissive", 0.9),
    ("gfdl", "gfdl", 0.4),
]
FAMILY = {name: (label, x) for names, label, x in FAMILIES for name in names.split()}
#: Published exceptions that may stand behind `with`.
EXCEPTIONS = frozenset("""
389-exception asterisk-exception autoconf-exception-2.0 autoconf-exception-3.0 autoconf-exception-generic autoconf-exception-macro
bison-exception-1.24 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 cryptsetup-openssl-exception
digirule-foss-exception ecos-exception-2.0 fawkes-runtime-exception fltk-exception fmt-exception font-exception-2.0 freertos-exception-2.0
gcc-exception-2.0 gcc-exception-2.0-note gcc-exception-3.1 gmsh-exception gnat-exception gnu-compiler-exception gnu-javamail-exception
gpl-3.0-interface-exception gpl-3.0-linking-exception gpl-3.0-linking-source-exception gpl-cc-1.0 gstreamer-exception-2005
gstreamer-exception-2008 i2p-gpl-java-exception kicad-libraries-exception lgpl-3.0-linking-exception libpri-openh323-exception
libtool-exception linux-syscall-note llgpl llvm-exception lzma-exception mif-exception ocaml-lgpl-linking-exception occt-exception-1.0
openjdk-assembly-exception-1.0 openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qpl-1.0-inria-2004-exception
qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 sane-exception shl-2.0 shl-2.1 stunnel-exception swi-exception
swift-exception texinfo-exception u-boot-exception-2.0 ubdl-exception universal-foss-exception-1.0 vsftpd-openssl-exception
wxwindows-exception-3.1 x11vnc-openssl-exception
""".split())  # fmt: skip
IDENTIFIERS = {name.format(v): (label, x) for names, versions, label, x in LICENSES for name in names.split() for v in (versions.split() or [""])}
PERMISSIVE = {label: x for label, x in IDENTIFIERS.values()} | {"gpl": 0.3, "bsd": 1.0, "public-domain": 1.0, "reserved": 0.0}
PERMISSIVE = {label: x for label, x in FAMILY.values()} | PERMISSIVE
#: What an identifier's version may be followed by: a country or another stated variant; and an exception, as older identifiers have it.
VARIANT = re.compile(r"(?<=[0-9a-z])-(?:[a-z]{2}|igo|no-invariants|invariants|cl8|perl|no-rfn|rfn)$")
OLD_EXCEPTION = re.compile(r"^(.*[0-9])-with-[a-z0-9-]+-exception$")
VERSION = re.compile(r"-v?[0-9]+(?:\.[0-9]+)*[a-z]?$")
#: Between two known identifiers a slash is read as `or`, a comma as `and`.
LIST = re.compile(r"\s*([/,])\s*([A-Za-z0-9.+-]+)")
RELAXES = 0.2
#: No published identifier is longer.
LONGEST = 100
TAGS = ("license identifier", "licence identifier")
TAG = re.compile(r"licen[sc]e-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+-]+)")
BINDS = {"or": 1, "and": 2, "with": 3}
#: Delimiters become spaces and A-Z lower case; all bytes of other characters stay.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def identified(token: str) -> tuple[str, float] | None:
    """Label and permissiveness of an identifier: a published one, or one made of a known name, a version and stated variants."""
    if len(token) > LONGEST:
        return None
    low = re.sub(r"(-only|-or-later|\+)$", "", token.lower())
    if m := OLD_EXCEPTION.match(low):
        found = identified(m[1])
        return found and (found[0], min(1.0, found[1] + RELAXES))
    if low in IDENTIFIERS:
        return IDENTIFIERS[low]
    if VERSION.search(low) and (found := FAMILY.get(VERSION.sub("", low))):
        return found
    shorter = VARIANT.sub("", low)
    return identified(shorter) if shorter != low and VERSION.search(shorter) else None


class Value(NamedTuple):
    labels: frozenset[str]
    permissive: float


def evaluate(expression: str) -> Value | None:
    """Labels and permissiveness of a licence expression; None if it is malformed.

    `with` relaxes a licence by a published exception only. An identifier that isn't known gives no label and permits nothing: with `and` nor does the whole, with `or` the
    other side may be chosen.
    """
    tokens, at = [], 0
    while at < len(expression.rstrip()):
        m = TOKEN.match(expression, at)
        if not m and tokens and (m := LIST.match(expression, at)) and identified(tokens[-1]) and identified(m[2]):
            tokens += ["or" if m[1] == "/" else "and", m[2]]
            at = m.end()
            continue
        if not m:
            break  # the expression ends where other text begins
        tokens.append(m[1])
        at = m.end()
    values: list[Value] = []
    operators: list[str] = []

    def apply() -> bool:
        if len(values) < 2:
            return False
        op, b, a = operators.pop(), values.pop(), values.pop()
        if op == "with":
            values.append(Value(a.labels, min(1.0, a.permissive + (0.0 if b.labels else b.permissive)) if a.labels else 0.0))
        else:
            values.append(Value(a.labels | b.labels, (max if op == "or" else min)(a.permissive, b.permissive)))
        return True

    operand = True  # what must come next
    for last, token in zip(["", *tokens], tokens):
        low = token.lower()
        if low in BINDS and not operand:
            while operators and operators[-1] != "(" and BINDS[operators[-1]] >= BINDS[low]:
                if not apply():
                    return None
            operators.append(low)
            operand = True
        elif token == "(" and operand:
            operators.append(token)
        elif token == ")" and not operand:
            while operators and operators[-1] != "(":
                if not apply():
                    return None
            if not operators:
                return None
            operators.pop()
        elif operand and token not in "()" and low not in BINDS:
            if last in BINDS and token.isalpha() and token.islower() and not identified(low):
                operators.pop()  # a small `and` before a plain word: text behind the expression
                operand = False
                break
            if operators and operators[-1] == "with":
                label, x = None, RELAXES if low in EXCEPTIONS else 0.0
            else:
                label, x = identified(low) or (None, 0.0)
            values.append(Value(frozenset([label] if label else []), x))
            operand = False
        else:
            break  # text behind the expression
    while operators:
        if operators[-1] == "(" or not apply():
            return None
    return values[0] if len(values) == 1 else None


def automaton(base: dict[str, str], notices: dict[str, str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*base, *notices, *TAGS}:
        padded = f" {phrase} "
        found.add_word(padded, (len(padded), base.get(phrase), notices.get(phrase), phrase in TAGS))
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple:
    """The values of FIELDS for one text."""
    words = (text or "").encode().translate(TO_WORDS).split()
    joined = f" {b' '.join(words).decode()} "
    places, first, last, base, labels, tagged = 0, None, None, set(), set(), False
    for end, (length, own, other, tag) in machine.iter(joined):
        if own:
            start = end - length + 1
            places += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(own)
        if other:
            labels.add(other)
        tagged |= tag
    scores, expressions = [], []
    if tagged:
        for m in TAG.finditer(text):
            expressions.append(m[1].strip())
            value = evaluate(m[1])
            if value is None:
                labels.update(found[0] for t in TOKEN.findall(m[1]) if (found := identified(t)))
            else:
                labels.update(value.labels)
                scores.append(value.permissive)
    labels |= base
    if not scores:
        scores = [PERMISSIVE[x] for x in labels if x in PERMISSIVE]
    word = lambda start: None if start is None else joined.count(" ", 0, start)
    return len(words), places, word(first), word(last), ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0), expressions


def scan_licenses(docs: DataFrame, text: str = "text", base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES) -> DataFrame:
    """docs with the columns FIELDS; expressions holds what stood behind identifier tags."""
    own = T._parse_datatype_string(FIELDS)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {f.name for f in own}])
    schema = T.StructType([*docs.schema.fields, *own.fields])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base, notices)
        for batch in batches:
            rows = [scan(x.as_py(), machine) for x in batch.column(text)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *own.names])

    return docs.mapInArrow(run, schema)
