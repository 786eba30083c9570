"""License scan: notice phrases and identifier tags by Aho-Corasick, license expressions by a shunting-yard parser.

A first automaton passes over each whole text and finds identifier tags, and the words without which there is no
notice. Texts that have such a word are folded: case, white space, line breaks with the comment leaders after them,
hyphens, slashes and commas become single spaces, so that a notice is found however it is wrapped. A second
automaton then finds the notices' phrases and the public identifiers. A phrase counts where no letter or digit adjoins it (a
point and a digit neither, as "version 2" is not "version 2.1"), and where no longer phrase covers it. After a tag, the rest
of the line is parsed as an expression (and, or, with, parentheses; "/" is or; with binds tightest, then and) and
evaluated: or takes the least, and the most restrictive side, and a known exception lowers a strong copyleft to a weak
one. A text's category is the most restrictive of its expressions and notices.

Defined results: texts without a notice, null and empty ones give no row. An expression that doesn't parse is
``invalid``, as restrictive as proprietary; an unknown identifier is ``unknown``. Repeated rows give a row each. Null
ids are kept. Other columns are ignored, whatever their names. Texts and lines of any length are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import map_text

#: From least to most restrictive.
CATEGORIES = ("public", "permissive", "weak-copyleft", "copyleft", "noncommercial", "unknown", "proprietary", "invalid")

#: The public identifiers by category; deprecated ones included.
_IDS = {
    "public": "0bsd cc0-1.0 cc-pddc libselinux-1.0 mit-0 pddl-1.0 unlicense wtfpl blessing sax-pd nist-pd nist-pd-fallback fair glwtpl",
    "permissive": """aal abstyles adobe-2006 adobe-glyph adsl afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 afmparse aml ampas antlr-pd apache-1.0 apache-1.1 apache-2.0 apafml app-s2p artistic-1.0 artistic-1.0-cl8 artistic-1.0-perl
        artistic-2.0 bahyph barr beerware bitstream-vera blueoak-1.0.0 borceux bsd-1-clause bsd-2-clause bsd-2-clause-freebsd bsd-2-clause-netbsd bsd-2-clause-patent bsd-2-clause-views bsd-3-clause bsd-3-clause-attribution bsd-3-clause-clear
        bsd-3-clause-lbnl bsd-3-clause-modification bsd-3-clause-open-mpi bsd-4-clause bsd-4-clause-shortened bsd-4-clause-uc bsd-protection bsd-source-code bsl-1.0 bzip2-1.0.5 bzip2-1.0.6 caldera cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-3.0-us cc-by-4.0
        cdla-permissive-1.0 cdla-permissive-2.0 cecill-b clartistic cnri-jython cnri-python crossword crystalstacker cube curl diffmark doc dotseqn dsdp dvipdfm ecl-1.0 ecl-2.0 efl-1.0 efl-2.0 egenix entessa etalab-2.0 eudatagrid
        freeimage fsfap fsful fsfullr ftl giftware gl2ps glulxe haskellreport hpnd hpnd-sell-variant ibm-pibs icu ijg imagemagick imatix info-zip intel intel-acpi isc jasper-2.0 jpnic json leptonica libpng libpng-2.0 libtiff linux-openib makeindex mirros
        mit mit-advertising mit-cmu mit-enna mit-feh mit-modern-variant mit-open-group mitnfa mpich2 mtll mulanpsl-1.0 mulanpsl-2.0 multics mup naist-2003 naumen ncsa net-snmp netcdf newsletr nlod-1.0 nlod-2.0 nls noweb nrl ntp ntp-0 oclc-2.0 odc-by-1.0 ofl-1.0 ofl-1.1
        ogc-1.0 ogl-uk-1.0 ogl-uk-2.0 ogl-uk-3.0 ogtsl oldap-2.0.1 oldap-2.1 oldap-2.2 oldap-2.4 oldap-2.5 oldap-2.6 oldap-2.7 oldap-2.8 oml openssl php-3.0 php-3.01 plexus postgresql psf-2.0 psfrag psutils python-2.0 python-2.0.1 qhull rdisc rsa-md ruby saxpath scea sendmail sgi-b-1.0 sgi-b-1.1 sgi-b-2.0 shl-0.5 shl-0.51
        smlnj snia spencer-86 spencer-94 spencer-99 ssh-openssh ssh-short ssleay-standalone sunpro swl tcl tcp-wrappers tosl tu-berlin-1.0 tu-berlin-2.0 ucl-1.0 unicode-3.0 unicode-dfs-2015 unicode-dfs-2016 unicode-tou upl-1.0 vim vsl-1.0 w3c w3c-19980720 w3c-20150513 wsuipa x11 xerox xfree86-1.1
        xinetd xnet xpp xskat zed zend-2.0 zimbra-1.3 zimbra-1.4 zlib zlib-acknowledgement zpl-1.1 zpl-2.0 zpl-2.1""",
    "weak-copyleft": """apl-1.0 apsl-1.0 apsl-1.1 apsl-1.2 apsl-2.0 cddl-1.0 cddl-1.1 cdla-sharing-1.0 cecill-c cern-ohl-w-2.0 cpal-1.0 cpl-1.0 cua-opl-1.0 d-fsl-1.0 ecos-2.0 epl-1.0 epl-2.0 erlpl-1.1 eupl-1.0 eupl-1.1 eupl-1.2 gsoap-1.3b interbase-1.0 ipa ipl-1.0
        lgpl-2.0 lgpl-2.1 lgpl-3.0 lgpllr lpl-1.0 lpl-1.02 lppl-1.0 lppl-1.1 lppl-1.2 lppl-1.3a lppl-1.3c mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl nbpl-1.0 nokia nosl npl-1.0 npl-1.1 odbl-1.0 omlf osl-1.0 oset-pl-2.1 phps ratfor rhecos-1.1 rpsl-1.0 sissl sissl-1.2 spl-1.0 tpl-1.0 wxwindows ypl-1.0 ypl-1.1""",
    "copyleft": """agpl-1.0 agpl-3.0 apl-2.0 cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cecill-1.0 cecill-1.1 cecill-2.0 cecill-2.1 cern-ohl-s-2.0 copyleft-next-0.3.0 copyleft-next-0.3.1 gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0
        latex2e mpl-2.0-gpl nposl-3.0 osl-1.1 osl-2.0 osl-2.1 osl-3.0 parity-6.0.0 parity-7.0.0 qpl-1.0 rpl-1.1 rpl-1.5 simpl-2.0 sleepycat sspl-1.0 tapr-ohl-1.0 vostrom watcom-1.0""",
    "noncommercial": """aladdin busl-1.1 cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-1.0 cc-by-nc-nd-2.0 cc-by-nc-nd-2.5 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-1.0 cc-by-nc-sa-2.0 cc-by-nc-sa-2.5 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0
        cc-by-nd-1.0 cc-by-nd-2.0 cc-by-nd-2.5 cc-by-nd-3.0 cc-by-nd-4.0 elastic-2.0 hippocratic-2.1 polyform-noncommercial-1.0.0 polyform-small-business-1.0.0 prosperity-3.0.0 nasa-1.3""",
}
LICENSES = {i: category for category, ids in _IDS.items() for i in ids.split()}
EXCEPTIONS = frozenset(
    """389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 clisp-exception-2.0 digirule-foss-exception ecos-exception-2.0 fawkes-runtime-exception fltk-exception font-exception-2.0
    freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gnu-javamail-exception gpl-3.0-linking-exception gpl-3.0-linking-source-exception gpl-cc-1.0 i2p-gpl-java-exception lgpl-3.0-linking-exception libtool-exception linux-syscall-note llvm-exception lzma-exception
    mif-exception nokia-qt-exception-1.1 ocaml-lgpl-linking-exception occt-exception-1.0 openjdk-assembly-exception-1.0 openvpn-openssl-exception ps-or-pdf-font-exception-20170817 qt-gpl-exception-1.0 qt-lgpl-exception-1.1 qwt-exception-1.0 shl-2.0 swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1""".split()
)
TAGS = ("spdx-license-identifier:", "license-identifier:")
NOTICES = {
    "mit license": "mit", "permission is hereby granted, free of charge": "mit", "expat license": "mit", "licensed under mit": "mit", "licensed under the mit": "mit",
    "apache license, version 2.0": "apache-2.0", "apache license version 2": "apache-2.0", "apache license 2.0": "apache-2.0", "apache software license 2.0": "apache-2.0", "apache license v2.0": "apache-2.0", "apache license v2": "apache-2.0", "apache license, version 1.1": "apache-1.1", "apache 2.0 license": "apache-2.0",
    "gnu general public license, version 1": "gpl-1.0", "gnu general public license, version 2": "gpl-2.0", "gnu general public license, version 3": "gpl-3.0", "gnu general public license v2": "gpl-2.0", "gnu general public license v3": "gpl-3.0", "gnu general public license v2.0": "gpl-2.0", "gnu general public license v3.0": "gpl-3.0",
    "gnu general public license, version 2.0": "gpl-2.0", "gnu general public license, version 3.0": "gpl-3.0", "gnu gpl version 2": "gpl-2.0", "gnu gpl version 3": "gpl-3.0", "gnu gpl v2": "gpl-2.0", "gnu gpl v3": "gpl-3.0", "gplv2": "gpl-2.0", "gplv3": "gpl-3.0", "gpl v2": "gpl-2.0", "gpl v3": "gpl-3.0", "gpl version 2": "gpl-2.0", "gpl version 3": "gpl-3.0", "gplv2+": "gpl-2.0", "gplv3+": "gpl-3.0", "gpl 2": "gpl-2.0", "gpl 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl-3.0", "gnu lesser general public license, version 2.1": "lgpl-2.1", "gnu lesser general public license v2.1": "lgpl-2.1", "gnu lesser general public license, version 3": "lgpl-3.0", "gnu library general public license": "lgpl-2.0", "lgplv2.1": "lgpl-2.1", "lgpl v2.1": "lgpl-2.1", "lgplv3": "lgpl-3.0", "lgpl v3": "lgpl-3.0", "lgpl version 2.1": "lgpl-2.1", "lgpl version 3": "lgpl-3.0",
    "gnu affero general public license": "agpl-3.0", "affero general public license": "agpl-3.0", "agplv3": "agpl-3.0", "agpl v3": "agpl-3.0", "gnu free documentation license": "gfdl-1.3", "server side public license": "sspl-1.0",
    "mozilla public license": "mpl-2.0", "mozilla public license, version 1.1": "mpl-1.1", "mplv2": "mpl-2.0", "eclipse public license": "epl-2.0", "eclipse public license v1.0": "epl-1.0", "eclipse public license 1.0": "epl-1.0", "common development and distribution license": "cddl-1.0", "common public license": "cpl-1.0", "european union public licence": "eupl-1.2",
    "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "2 clause bsd": "bsd-2-clause", "3 clause bsd": "bsd-3-clause", "simplified bsd license": "bsd-2-clause", "new bsd license": "bsd-3-clause", "modified bsd license": "bsd-3-clause", "bsd license": "bsd-3-clause", "redistribution and use in source and binary forms": "bsd-3-clause",
    "isc license": "isc", "permission to use, copy, modify, and or distribute this software": "isc", "boost software license": "bsl-1.0", "zlib license": "zlib", "artistic license 2.0": "artistic-2.0", "artistic license": "artistic-1.0", "python software foundation license": "psf-2.0", "php license": "php-3.01", "sil open font license": "ofl-1.1", "w3c software license": "w3c", "zope public license": "zpl-2.1", "academic free license": "afl-3.0", "universal permissive license": "upl-1.0", "business source license": "busl-1.1", "elastic license 2.0": "elastic-2.0",
    "cc0": "cc0-1.0", "released into the public domain": "unlicense", "this is free and unencumbered software": "unlicense", "do what the fuck you want to public license": "wtfpl", "creative commons zero": "cc0-1.0", "dedicated to the public domain": "cc0-1.0",
    "creative commons attribution 4.0": "cc-by-4.0", "creative commons attribution 3.0": "cc-by-3.0", "creative commons attribution sharealike 4.0": "cc-by-sa-4.0", "creative commons attribution share alike 4.0": "cc-by-sa-4.0", "creative commons attribution sharealike 3.0": "cc-by-sa-3.0",
    "creative commons attribution noncommercial 4.0": "cc-by-nc-4.0", "creative commons attribution non commercial 4.0": "cc-by-nc-4.0", "creative commons attribution noncommercial sharealike 4.0": "cc-by-nc-sa-4.0", "creative commons attribution noncommercial noderivatives 4.0": "cc-by-nc-nd-4.0", "creative commons attribution noderivatives 4.0": "cc-by-nd-4.0",
    "all rights reserved": "proprietary", "proprietary and confidential": "proprietary", "confidential and proprietary": "proprietary",
}
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9.+\-:]+")
_CLOSING = re.compile(r"\s*(?:\*/|-->|\"\"\"|#|;).*$")
#: White space that is not one space, with the comment leaders of a line that begins after it; and what else joins words.
_SPACE = re.compile(r"(?:[^\S\n]*\n[^\S\n]*(?:(?:[#*;%|>!]+|//+|--+|/\*+|\"\"\"|'{3}|<!--|\.\.|rem|dnl)(?![a-z0-9]))?[^\S\n]*)+|[^\S\n]{2,}|[^\S\n ]|(?:\s*[-/,_\"'“”`]+)+\s*")


def fold(text: str) -> str:
    """A lower-case text with what separates words made single spaces."""
    return _SPACE.sub(" ", text)


def _phrases() -> dict[str, str]:
    """Folded phrases: the notices, and the identifiers that hold a digit and are no plain word."""
    out = {fold(i): i for i in LICENSES if len(i) >= 6 and any(c.isdigit() for c in i) and "-" in i}
    for i in list(out.values()):
        if LICENSES[i] in ("copyleft", "weak-copyleft") and "gpl" in i:
            out |= {fold(f"{i}-{k}"): i for k in ("only", "or-later")}
    return out | {fold(k): v for k, v in NOTICES.items()}


PHRASES = _phrases()


class ExpressionError(ValueError):
    """A license expression that doesn't parse."""


def to_rpn(expression: str) -> list[str]:
    """A license expression in reverse Polish notation (shunting-yard)."""
    out: list[str] = []
    stack: list[str] = []
    lowered = expression.lower().replace("/", " or ")
    if re.sub(r"[()a-z0-9.+\-:\s]", "", lowered):
        raise ExpressionError(expression)
    operand = True
    for token in _TOKEN.findall(lowered):
        if token in _PRECEDENCE:
            if operand:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif token == ")":
            if operand:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError(expression)
            stack.pop()
        else:
            if not operand:
                raise ExpressionError(expression)
            if token == "(":
                stack.append(token)
            else:
                out.append(token)
                operand = False
    if operand or "(" in stack:
        raise ExpressionError(expression)
    return out + stack[::-1]


def category_of(license_id: str) -> str:
    """The category of one identifier."""
    base = re.sub(r"(-only|-or-later|\+)$", "", license_id)
    return base if base == "proprietary" else LICENSES.get(base, "unknown")


def evaluate(expression: str) -> str:
    """The category of an expression; ``invalid`` if it doesn't parse."""
    try:
        stack: list[tuple[str, str]] = []
        for token in to_rpn(expression):
            if token not in _PRECEDENCE:
                stack.append((token, category_of(token)))
                continue
            b, a = stack.pop(), stack.pop()
            if token == "with":
                if a[0] == "" or b[0] == "":
                    raise ExpressionError(expression)
                stack.append(("", "weak-copyleft" if a[1] == "copyleft" and b[0] in EXCEPTIONS else a[1]))
            else:
                pick = min if token == "or" else max
                stack.append(("", pick(a[1], b[1], key=CATEGORIES.index)))
        return stack[0][1]
    except (ExpressionError, IndexError):
        return "invalid"


#: Words of phrases that any text may have.
_PLAIN = frozenset("only later version or the public general free source with under this that any work share alike by to and is of into new use".split())


def anchor(phrase: str) -> str:
    """The longest word of a phrase that isn't plain: a text without it doesn't hold the phrase."""
    return max(re.findall(r"[a-z0-9.+]+", phrase), key=lambda w: (w not in _PLAIN, len(w), w))


def automaton():
    """The automaton of tags and of the phrases' longest words, and the one of phrases."""
    import ahocorasick

    first, second = ahocorasick.Automaton(), ahocorasick.Automaton()
    for word in {anchor(p) for p in PHRASES}:
        first.add_word(word, len(word))
    for tag in TAGS:
        first.add_word(tag, 0)
    for phrase, license_id in PHRASES.items():
        second.add_word(phrase, (len(phrase), license_id))
    first.make_automaton()
    second.make_automaton()
    return first, second


def notices(text: str, machine) -> set[str]:
    """The licenses whose phrases a folded text holds."""
    found = []
    for end, (n, license_id) in machine.iter(text):
        start, after = end - n + 1, text[end + 1 : end + 3]
        if not (start and text[start - 1].isalnum()) and not after[:1].isalnum() and not (after[:1] == "." and after[1:].isdigit()):
            found.append((start, -end, license_id))
    # a phrase within a longer one says nothing of its own
    out, reached = set(), -1
    for start, end, license_id in sorted(found):
        if -end > reached:
            out.add(license_id)
            reached = -end
    return out


def scan(text: str, machine) -> tuple[list[str], list[str], str] | None:
    """Notices' licenses and tags' expressions of a lower-case text, and its category; None if it has neither."""
    first, second = machine
    tags, anchored = [], False
    for end, n in first.iter(text):
        if not n:
            tags.append(end)
        elif not anchored:
            anchored = not (end >= n and text[end - n].isalnum()) and not text[end + 1 : end + 2].isalnum()
    expressions = set()
    # of two tags that end at one place the longer one stands for both
    for end in sorted(set(tags)):
        stop = text.find("\n", end)
        expressions.add(" ".join(_CLOSING.sub("", text[end + 1 : stop if stop >= 0 else len(text)]).split()))
    licenses = notices(fold(text), second) if anchored else set()
    if tags and licenses:
        # an identifier in a tag is the tag's
        named = {re.sub(r"(-only|-or-later|\+)$", "", t) for e in expressions for t in _TOKEN.findall(e.replace("/", " "))}
        licenses -= {i for i in licenses & named if not notices(fold(_untagged(text)), second) & {i}}
    if not licenses and not expressions:
        return None
    found = sorted(expressions)
    categories = [category_of(x) for x in licenses] + [evaluate(x) for x in found]
    return sorted(licenses), found, max(categories, key=CATEGORIES.index)


def _untagged(text: str) -> str:
    """A text without the lines' parts after a tag."""
    return re.sub(r"license-identifier:[^\n]*", "", text)


def _scan_batches():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            _, offsets = tokens.texts_of(batch.column(1))
            for i, j in tokens.groups(offsets):
                rows = [(k, found) for k, text in enumerate(batch.column(1).slice(i, j - i).to_pylist()) if text and (found := scan(text, machine))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array([k for k, _ in rows], pa.int64())),
                        pa.array([f[0] for _, f in rows], pa.list_(pa.string())),
                        pa.array([f[1] for _, f in rows], pa.list_(pa.string())),
                        pa.array([f[2] for _, f in rows], pa.string()),
                    ],
                    names=["doc_id", "licenses", "expressions", "category"],
                )

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """Documents with license notices: ``doc_id``, their ``licenses`` and ``expressions``, and ``category``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    return map_text(
        rows, _scan_batches(), "doc_id long, licenses array<string>, expressions array<string>, category string"
    )
