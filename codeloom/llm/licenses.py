"""License scans: one Aho-Corasick pass finds identifier tags and notice phrases; a shunting-yard parser
evaluates the licence expressions after the tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import fold, found_rows, parts, with_ids, worker_cache

#: How free the use of each licence of the public SPDX list is: 0 permissive, 1 weak copyleft, 2 strong copyleft,
#: 3 non-commercial, without derivatives or proprietary (Proprietary itself isn't of the list).
_NAMES = {
    0: """
        0BSD AAL Abstyles Adobe-2006 Adobe-Glyph ADSL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 Afmparse AMDPLPA AML AMPAS ANTLR-PD Apache-1.0
        Apache-1.1 Apache-2.0 APAFML App-s2p Artistic-1.0 Artistic-1.0-cl8 Artistic-1.0-Perl Artistic-2.0 Bahyph Barr bcrypt-Solar-Designer Beerware
        Bitstream-Charter Bitstream-Vera blessing BlueOak-1.0.0 Boehm-GC Borceux BSD-1-Clause BSD-2-Clause BSD-2-Clause-FreeBSD BSD-2-Clause-NetBSD
        BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-acpica BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-flex
        BSD-3-Clause-HP BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-Open-MPI BSD-3-Clause-Sun BSD-4-Clause BSD-4-Clause-Shortened
        BSD-4-Clause-UC BSD-4.3RENO BSD-4.3TAHOE BSD-Source-Code BSD-Systemics BSL-1.0 bzip2-1.0.5 bzip2-1.0.6 Caldera CC-BY-1.0 CC-BY-2.0 CC-BY-2.5
        CC-BY-2.5-AU CC-BY-3.0 CC-BY-3.0-AT CC-BY-3.0-AU CC-BY-3.0-DE CC-BY-3.0-IGO CC-BY-3.0-NL CC-BY-3.0-US CC-BY-4.0 CC-PDDC CC0-1.0
        CDLA-Permissive-1.0 CDLA-Permissive-2.0 CERN-OHL-P-2.0 CFITSIO checkmk ClArtistic CMU-Mach CNRI-Jython CNRI-Python CNRI-Python-GPL-Compatible
        COIL-1.0 Community-Spec-1.0 Cornell-Lossless-JPEG Crossword CrystalStacker Cube curl DOC Dotseqn DRL-1.0 DSDP dtoa dvipdfm ECL-1.0 ECL-2.0
        EFL-1.0 EFL-2.0 eGenix Entessa EPICS etalab-2.0 EUDatagrid Eurosym Fair FDK-AAC FSFAP FSFUL FSFULLR FTL GD Giftware GL2PS Glide Glulxe gnuplot
        Graphics-Gems HaskellReport HP-1986 HPND HPND-sell-variant HTMLTIDY IBM-pibs ICU IJG IJG-short ImageMagick Imlib2 Info-ZIP Intel Intel-ACPI
        ISC JasPer-2.0 JPNIC JSON Kazlib Latex2e Leptonica Libpng libpng-2.0 libselinux-1.0 libtiff libutil-David-Nugent Linux-man-pages-1-para
        Linux-OpenIB LOOP LPL-1.0 LPL-1.02 LZMA-SDK-9.22 MakeIndex Martin-Birgmeier metamail Minpack MirOS MIT MIT-0 MIT-advertising MIT-CMU MIT-enna
        MIT-feh MIT-Festival MIT-Modern-Variant MIT-open-group MIT-Wu MITNFA mpi-permissive mpich2 mplus MS-PL MTLL MulanPSL-1.0 MulanPSL-2.0 Multics
        Mup Naumen NBPL-1.0 NCSA Net-SNMP NetCDF Newsletr NICTA-1.0 NIST-PD NIST-PD-fallback NIST-Software NLOD-1.0 NLOD-2.0 Noweb NRL NTP NTP-0
        O-UDA-1.0 ODC-By-1.0 OFFIS OFL-1.0 OFL-1.0-no-RFN OFL-1.0-RFN OFL-1.1 OFL-1.1-no-RFN OFL-1.1-RFN OGC-1.0 OGL-Canada-2.0 OGL-UK-1.0 OGL-UK-2.0
        OGL-UK-3.0 OGTSL OLDAP-2.0 OLDAP-2.0.1 OLDAP-2.1 OLDAP-2.2 OLDAP-2.2.1 OLDAP-2.2.2 OLDAP-2.3 OLDAP-2.4 OLDAP-2.5 OLDAP-2.6 OLDAP-2.7 OLDAP-2.8
        OML OpenSSL OPUBL-1.0 PDDL-1.0 PHP-3.0 PHP-3.01 Plexus PostgreSQL PSF-2.0 psfrag psutils Python-2.0 Python-2.0.1 Qhull Rdisc RSA-MD Ruby
        SAX-PD Saxpath SCEA Sendmail SGI-B-1.0 SGI-B-1.1 SGI-B-2.0 SHL-0.5 SHL-0.51 SMLNJ SNIA Spencer-86 Spencer-94 Spencer-99 SSH-OpenSSH SSH-short
        SunPro SWL TCL TCP-wrappers TOSL TTWL TU-Berlin-1.0 TU-Berlin-2.0 UCL-1.0 Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 Unlicense UPL-1.0
        VSL-1.0 W3C W3C-19980720 W3C-20150513 Wsuipa WTFPL X11 X11-distribute-modifications-variant Xerox Xfig XFree86-1.1 xinetd xlock Xnet xpp XSkat
        Zed Zend-2.0 Zlib zlib-acknowledgement ZPL-1.1 ZPL-2.0 ZPL-2.1
    """,
    1: """
        APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 CATOSL-1.1 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-3.0-AT CC-BY-SA-3.0-DE
        CC-BY-SA-3.0-IGO CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CDLA-Sharing-1.0 CECILL-B CECILL-C CERN-OHL-W-2.0 CPL-1.0 CUA-OPL-1.0 eCos-2.0 EPL-1.0 EPL-2.0
        ErlPL-1.1 Frameworx-1.0 FreeImage GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later gSOAP-1.3b
        Interbase-1.0 IPL-1.0 LAL-1.2 LAL-1.3 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LGPLLR
        Linux-man-pages-copyleft LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c Motosoto MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-RL
        NASA-1.3 Nokia NOSL NPL-1.0 NPL-1.1 OCLC-2.0 ODbL-1.0 OSET-PL-2.1 RHeCos-1.1 RPSL-1.0 RSCPL SISSL SISSL-1.2 SPL-1.0 SugarCRM-1.1.3 TMate
        TORQUE-1.1 Vim Watcom-1.0 wxWindows YPL-1.0 YPL-1.1 Zimbra-1.3 Zimbra-1.4
    """,
    2: """
        AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0-only AGPL-3.0-or-later CAL-1.0 CAL-1.0-Combined-Work-Exception CECILL-1.0 CECILL-1.1 CECILL-2.0
        CECILL-2.1 CERN-OHL-1.1 CERN-OHL-1.2 CERN-OHL-S-2.0 copyleft-next-0.3.0 copyleft-next-0.3.1 CPAL-1.0 D-FSL-1.0 EUPL-1.0 EUPL-1.1 EUPL-1.2
        GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 NGPL
        NPOSL-3.0 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 Parity-6.0.0 Parity-7.0.0 QPL-1.0 RPL-1.1 RPL-1.5 SimPL-2.0 Sleepycat SSPL-1.0 TAPR-OHL-1.0
    """,
    3: """
        Aladdin APL-1.0 Arphic-1999 BUSL-1.1 C-UDA-1.0 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-3.0-DE CC-BY-NC-4.0
        CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-3.0-DE CC-BY-NC-ND-3.0-IGO CC-BY-NC-ND-4.0 CC-BY-NC-SA-1.0
        CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.0-DE CC-BY-NC-SA-2.0-FR CC-BY-NC-SA-2.0-UK CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-3.0-DE
        CC-BY-NC-SA-3.0-IGO CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-3.0-DE CC-BY-ND-4.0 CPOL-1.02 Elastic-2.0
        Hippocratic-2.1 JPL-image NCGL-UK-2.0 PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 Proprietary
    """,
}
LICENSES = {name: k for k, names in _NAMES.items() for name in names.split()}
#: Older spellings: GNU licences without -only and with +, and some others.
ALIASES = {"apache 2.0": "Apache-2.0", "bsd-2-clause-freebsd": "BSD-2-Clause", "bsd-2-clause-netbsd": "BSD-2-Clause", "cc0": "CC0-1.0", "net-snmp": "Net-SNMP", "nunit": "Zlib", "standardml-nj": "SMLNJ"}
for _family, _versions in {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("1.0", "3.0"), "GFDL": ("1.1", "1.2", "1.3")}.items():
    for _v in _versions:
        ALIASES |= {f"{_family}-{_v}".lower(): f"{_family}-{_v}-only", f"{_family}-{_v}+".lower(): f"{_family}-{_v}-or-later"}
#: Exceptions that make strong copyleft as weak as a library licence.
EXCEPTIONS = {x.lower(): x for x in """
    389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 DigiRule-FOSS-exception
    eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception Font-exception-2.0 freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 gnu-javamail-exception GPL-3.0-linking-exception
    GPL-3.0-linking-source-exception GPL-CC-1.0 i2p-gpl-java-exception LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note LLVM-exception LZMA-exception mif-exception
    OCaml-LGPL-linking-exception OCCT-exception-1.0 OpenJDK-assembly-exception-1.0 openvpn-openssl-exception PS-or-PDF-font-exception-20170817 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1
    Qwt-exception-1.0 SHL-2.0 SHL-2.1 Swift-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1
""".split()}
CATEGORIES = ("permissive", "weak-copyleft", "strong-copyleft", "restricted")
#: Category of an identifier that isn't on the list.
UNKNOWN = 3

TAGS = ("spdx-license-identifier:", "license-expression:", "@license ")
PHRASES = {
    "released under the mit license": "MIT", "licensed under the mit license": "MIT", "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT", "the mit license (mit)": "MIT",
    "licensed under the apache license, version 2.0": "Apache-2.0", "apache license, version 2.0": "Apache-2.0",
    "redistribution and use in source and binary forms, with or without modification": "BSD-3-Clause",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "ISC",
    "gnu general public license, version 3": "GPL-3.0-only", "gnu general public license, version 2": "GPL-2.0-only", "gnu general public license v3": "GPL-3.0-only", "gnu general public license v2": "GPL-2.0-only",
    "gnu general public license as published by the free software foundation": "GPL-2.0-or-later",
    "gnu lesser general public license, version 3": "LGPL-3.0-only", "gnu lesser general public license, version 2.1": "LGPL-2.1-only", "gnu affero general public license, version 3": "AGPL-3.0-only",
    "mozilla public license, version 2.0": "MPL-2.0", "mozilla public license, v. 2.0": "MPL-2.0", "eclipse public license, version 2.0": "EPL-2.0", "eclipse public license - v 2.0": "EPL-2.0",
    "licensed under cc by 4.0": "CC-BY-4.0", "licensed under cc by-sa 4.0": "CC-BY-SA-4.0", "licensed under cc by-nc 4.0": "CC-BY-NC-4.0", "licensed under cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "licensed under cc by-nd 4.0": "CC-BY-ND-4.0", "licensed under cc0 1.0": "CC0-1.0",
    "creative commons attribution 4.0 international": "CC-BY-4.0", "creative commons attribution-sharealike 4.0 international": "CC-BY-SA-4.0", "creative commons attribution-noncommercial 4.0 international": "CC-BY-NC-4.0",
    "this is free and unencumbered software released into the public domain": "Unlicense", "boost software license - version 1.0": "BSL-1.0",
    "all rights reserved. proprietary and confidential": "Proprietary",
}

_BY_LOW = {i.lower(): i for i in LICENSES} | ALIASES
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
#: What begins and ends the lines of comments.
_SIGNS, _END_SIGNS = " \t*#/;%>|!", " \t*#/|"
_COMMENT_WORD = re.compile(r"(?:rem|dnl)[ \t]+")
_RANK = {"or": 1, "and": 2, "with": 3}

FOUND = "n_tags int, n_notices int, expression string, licenses string, category string, allowed boolean, problem string"
_FOUND = [("n_tags", pa.int32()), ("n_notices", pa.int32()), ("expression", pa.string()), ("licenses", pa.string()), ("category", pa.string()), ("allowed", pa.bool_()), ("problem", pa.string())]


class ExpressionError(ValueError):
    pass


def postfix(text: str, at: int = 0) -> tuple[list[str], int]:
    """Shunting yard: the licence expression at a place of a lower-case text, in postfix order, and where it ends.

    ``with`` binds tighter than ``and``, ``and`` than ``or``. The expression ends at a word that can't continue it
    and, since only blanks and tabs part its words, with its line.
    """
    out: list[str] = []
    stack: list[str] = []
    want, depth = True, 0
    while m := _TOKEN.match(text, at):
        token = m[1]
        if want:
            if token == "(":
                if stack and stack[-1] == "with":
                    raise ExpressionError("an exception is a name")
                stack.append(token)
                depth += 1
            elif token == ")" or token in _RANK:
                raise ExpressionError(f"{token} where a licence should be")
            else:
                token = token.rstrip(".:-") or token
                out.append(token)
                at = m.start(1) + len(token)
                want = False
                continue
        elif token in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            want = True
        elif token == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            break
        at = m.end()
    if want or depth:
        raise ExpressionError("the expression ends too early")
    while stack:
        out.append(stack.pop())
    return out, at


def evaluate(rpn: list[str]) -> tuple[str, set[str], int]:
    """(expression in standard spelling, its licences, category): ``or`` lets the user choose the freer side,
    ``and`` binds to the stricter, ``with`` an exception weakens strong copyleft."""
    stack: list[tuple[str, set[str], int, int]] = []
    for k, token in enumerate(rpn):
        if token not in _RANK:
            name = _BY_LOW.get(token, EXCEPTIONS.get(token, token))
            stack.append((name, {name}, LICENSES.get(name, UNKNOWN), 4))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            if a[3] != 4:
                raise ExpressionError("only a licence has an exception")
            known = b[0] in EXCEPTIONS.values()
            stack.append((f"{a[0]} WITH {b[0]}", a[1], min(a[2], 1) if known and a[2] == 2 else a[2], 3))
            continue
        rank = _RANK[token]
        left, right = (x[0] if x[3] >= rank else f"({x[0]})" for x in (a, b))
        stack.append((f"{left} {token.upper()} {right}", a[1] | b[1], (min if token == "or" else max)(a[2], b[2]), rank))
    name, licenses, category, _ = stack[0]
    return name, licenses, category


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for tag in TAGS:
        out.add_word(tag, (tag, None))
    for phrase, name in PHRASES.items():
        out.add_word(phrase, (phrase, name))
    out.make_automaton()
    return out


def joined(low: str) -> str:
    """The text as one line: comment signs around lines dropped, runs of white space made one space."""
    lines = []
    for line in low.splitlines():
        line = line.strip().removeprefix("<!--").lstrip(_SIGNS)
        if line.startswith("--"):
            line = line.lstrip("- ")
        elif m := _COMMENT_WORD.match(line):
            line = line[m.end() :]
        lines.append(line.rstrip(_END_SIGNS))
    return " ".join(" ".join(lines).split())


def scan_text(text: str | None, finder: ahocorasick.Automaton, most: int) -> tuple | None:
    """(tags, notices, expression, licences, category, allowed, problem) of one text, or None if it names no licence."""
    if not text:
        return None
    low = fold(text)
    flat = low.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "})
    tags, notices, last = [end + 1 for end, (_, name) in finder.iter(flat) if name is None], [], (-1, -1)
    for end, (word, name) in finder.iter(joined(low)):
        start = end - len(word) + 1
        if name is None:
            continue
        if start > last[1]:
            notices.append(name)
            last = start, end
        elif start <= last[0]:  # the longer of two phrases that end together or later
            notices[-1] = name
            last = start, end
    if not tags and not notices:
        return None
    found: dict[str, tuple[set[str], int]] = {}
    problem = None
    for at in tags:
        try:
            rpn, _ = postfix(low, at)
            expression, names, category = evaluate(rpn)
            found[expression] = names, category
        except ExpressionError as e:
            problem = problem or str(e)
    for name in notices:
        found[name] = {name}, LICENSES[name]
    if not found:
        return len(tags), len(notices), None, None, None, False, problem
    category = max(c for _, c in found.values())
    licenses = sorted(set().union(*(n for n, _ in found.values())))
    return len(tags), len(notices), "; ".join(sorted(found)), ",".join(licenses), CATEGORIES[category], category <= most and problem is None, problem


def licenses(docs: DataFrame, most: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs that names a licence, by tag or notice.

    expression holds its distinct expressions, sorted, joined by ``; ``; category is the strictest of them;
    allowed is whether that is within ``most`` (0 permissive to 3) and every tag's expression could be read.
    An expression that can't be read gives ``problem``; if there's no other, expression is null. Line breaks in
    notices, with the indentation and comment signs after them, and runs of white space count as one space; a tag's expression ends with its line. Null and empty texts name none; null ids
    and repeated rows are kept, ids keep their type; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = worker_cache("licenses", automaton)
        for batch in parts(batches, 1):
            yield found_rows(batch.column(0), ((i, *row) for i, t in enumerate(batch.column(1)) if (row := scan_text(t.as_py(), finder, most))), _FOUND)

    rows, schema = with_ids(docs, id_col, text_col, FOUND)
    return rows.mapInArrow(run, schema)
