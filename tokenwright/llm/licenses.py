"""License scans: Aho-Corasick finds identifier tags and notice phrases, and a shunting-yard parser
evaluates the and/or/with expressions behind the tags.

Defined cases: a null or empty text has no finding (status 'none'); a tag without a valid expression
has status 'invalid' unless something else is found; an unknown identifier that is well-formed stays
an operand of unknown rank, and where it decides, the obligation is null; an expression of nothing
but unknown names without a version is invalid; notices are read with white space and comment marks
folded to one space, tags to the end of their line; a phrase within a longer one doesn't count (ties:
the later start goes); several findings of a text hold together, as if joined by AND, and repeats of
one are one; negations ("not the MIT License") aren't understood; a text of any length is scanned whole;
repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slim

# obligations, from least to most
RANKS = ("public-domain", "permissive", "weak-copyleft", "copyleft", "network-copyleft", "no-derivatives", "non-commercial")
_BY_RANK = (
    "CC0-1.0 Unlicense 0BSD WTFPL CC-PDDC PDDL-1.0 SAX-PD NIST-PD NIST-PD-fallback blessing libselinux-1.0 TU-Berlin-1.0 MIT-0 BSD-1-Clause",
    "MIT MIT-advertising MIT-CMU MIT-enna MIT-feh MIT-Festival MIT-Modern-Variant MIT-open-group MIT-testregex MIT-Wu MITNFA Apache-1.0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-2-Clause-FreeBSD BSD-2-Clause-NetBSD BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-Open-MPI BSD-3-Clause-HP BSD-3-Clause-Sun BSD-4-Clause BSD-4-Clause-UC BSD-4-Clause-Shortened BSD-4.3RENO BSD-4.3TAHOE BSD-Attribution-HPND-disclaimer BSD-Protection BSD-Source-Code BSD-Systemics BSL-1.0 bzip2-1.0.5 bzip2-1.0.6 "
    "ISC ISC-Veillard Zlib zlib-acknowledgement Python-2.0 Python-2.0.1 PSF-2.0 CNRI-Python CNRI-Jython CNRI-Python-GPL-Compatible PostgreSQL CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-2.5-AU CC-BY-3.0-AT CC-BY-3.0-DE CC-BY-3.0-IGO CC-BY-3.0-NL CC-BY-3.0-US Artistic-2.0 NCSA X11 X11-distribute-modifications-variant XFree86-1.1 Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 Unicode-TOU AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AAL Abstyles Adobe-2006 Adobe-Glyph ADSL Afmparse AMDPLPA AML AMPAS ANTLR-PD Bahyph Barr Beerware Bitstream-Vera BlueOak-1.0.0 Borceux Caldera "
    "CC-PDM-1.0 CDLA-Permissive-1.0 CDLA-Permissive-2.0 Crossword CrystalStacker Cube curl diffmark DOC Dotseqn DSDP dvipdfm ECL-1.0 ECL-2.0 eGenix EFL-1.0 EFL-2.0 Entessa Fair FreeImage FSFAP FSFUL FSFULLR FSFULLRWD FTL GD Giftware Glulxe HPND HPND-sell-variant HPND-Markus-Kuhn HTMLTIDY IBM-pibs ICU IJG IJG-short ImageMagick Info-ZIP Intel JasPer-2.0 JPNIC Leptonica Libpng libpng-2.0 libtiff Linux-OpenIB LOOP LPL-1.0 LPL-1.02 MakeIndex MirOS mpich2 MTLL MulanPSL-1.0 MulanPSL-2.0 Multics Mup NAIST-2003 Naumen NBPL-1.0 Net-SNMP NetCDF Newsletr NLOD-1.0 NLOD-2.0 NLPL Noweb NRL NTP NTP-0 OFFIS OFL-1.0 OFL-1.1 OFL-1.0-no-RFN OFL-1.0-RFN OFL-1.1-no-RFN OFL-1.1-RFN OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 OGTSL OLDAP-2.0 OLDAP-2.0.1 OLDAP-2.1 OLDAP-2.2 OLDAP-2.3 OLDAP-2.4 OLDAP-2.5 OLDAP-2.6 OLDAP-2.7 OLDAP-2.8 OML OpenSSL "
    "PHP-3.0 PHP-3.01 Plexus psfrag psutils Qhull Rdisc RSA-MD Ruby Saxpath SCEA SGI-B-1.1 SGI-B-2.0 SHL-0.5 SHL-0.51 SMLNJ SNIA Spencer-86 Spencer-94 Spencer-99 SSH-OpenSSH SSH-short StandardML-NJ SunPro SWL TCL TCP-wrappers TMate TOSL TTWL UCAR UPL-1.0 Vim VSL-1.0 W3C W3C-19980720 W3C-20150513 w3m Wsuipa xinetd Xerox Xnet xpp XSkat Zed Zend-2.0 ZPL-1.1 ZPL-2.0 ZPL-2.1 etalab-2.0 COIL-1.0 Community-Spec-1.0 SISSL SISSL-1.2 Xdebug-1.03 gnuplot GL2PS Condor-1.1 ClArtistic DL-DE-BY-2.0",
    "LGPL-2.0 LGPL-2.0+ LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only LGPL-3.0-or-later LGPLLR MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 IPL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Artistic-1.0 Artistic-1.0-cl8 Artistic-1.0-Perl CATOSL-1.1 CUA-OPL-1.0 ErlPL-1.1 gSOAP-1.3b Interbase-1.0 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c MS-PL MS-RL NOSL NPL-1.0 NPL-1.1 Nokia NPOSL-3.0 OCLC-2.0 OPL-1.0 OSET-PL-2.1 Frameworx-1.0 RHeCos-1.1 SPL-1.0 SugarCRM-1.1.3 YPL-1.0 YPL-1.1 Zimbra-1.3 Zimbra-1.4 eCos-2.0 wxWindows CERN-OHL-1.1 CERN-OHL-1.2 CERN-OHL-P-2.0 CERN-OHL-W-2.0 TAPR-OHL-1.0 CDLA-Sharing-1.0 Motosoto BitTorrent-1.0 BitTorrent-1.1 NASA-1.3 LiLiQ-P-1.1 LiLiQ-R-1.1 LiLiQ-Rplus-1.1 Intel-ACPI QPL-1.0 QPL-1.0-INRIA-2004",
    "GPL-1.0 GPL-1.0+ GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-SA-2.0-UK CC-BY-SA-2.1-JP CC-BY-SA-3.0-AT CC-BY-SA-3.0-DE CC-BY-SA-3.0-IGO CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CERN-OHL-S-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 EUDatagrid GFDL-1.1 GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2 GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3 GFDL-1.3-only GFDL-1.3-or-later GFDL-1.1-invariants-only GFDL-1.2-invariants-only GFDL-1.3-invariants-only GFDL-1.1-no-invariants-only GFDL-1.2-no-invariants-only GFDL-1.3-no-invariants-only ODbL-1.0 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 Sleepycat SimPL-2.0 copyleft-next-0.3.0 copyleft-next-0.3.1 FDK-AAC LAL-1.2 LAL-1.3 OPUBL-1.0 CECILL-B CECILL-C",
    "AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0+ AGPL-3.0-only AGPL-3.0-or-later SSPL-1.0 CPAL-1.0 RPL-1.1 RPL-1.5 Parity-6.0.0 Parity-7.0.0 Watcom-1.0 CAL-1.0 CAL-1.0-Combined-Work-Exception",
    "CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-ND-3.0-DE",
    "CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-3.0-DE CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-SA-2.0-DE CC-BY-NC-SA-2.0-FR CC-BY-NC-SA-2.0-UK CC-BY-NC-SA-3.0-DE CC-BY-NC-SA-3.0-IGO CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-ND-3.0-DE CC-BY-NC-ND-3.0-IGO PolyForm-Noncommercial-1.0.0 Prosperity-3.0.0 Hippocratic-2.1 Aladdin BUSL-1.1 Elastic-2.0",
)
KNOWN = {name: rank for rank, names in enumerate(_BY_RANK) for name in names.split()}
_CANON = {k.lower(): k for k in KNOWN}
EXCEPTIONS = {
    x.lower(): x
    for x in (
        "389-exception Asterisk-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Autoconf-exception-generic Autoconf-exception-macro Bison-exception-1.24 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 cryptsetup-OpenSSL-exception DigiRule-FOSS-exception eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception fmt-exception Font-exception-2.0 freertos-exception-2.0 GCC-exception-2.0 GCC-exception-2.0-note GCC-exception-3.1 GNAT-exception gnu-javamail-exception GNU-compiler-exception GPL-3.0-interface-exception GPL-3.0-linking-exception GPL-3.0-linking-source-exception GPL-CC-1.0 GStreamer-exception-2005 GStreamer-exception-2008 i2p-gpl-java-exception KiCad-libraries-exception LGPL-3.0-linking-exception libpri-OpenH323-exception Libtool-exception Linux-syscall-note LLGPL LLVM-exception LZMA-exception mif-exception Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception OCCT-exception-1.0 OpenJDK-assembly-exception-1.0 openvpn-openssl-exception OpenSSL-exception PS-or-PDF-font-exception-20170817 QPL-1.0-INRIA-2004-exception Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0 SANE-exception SHL-2.0 SHL-2.1 stunnel-exception SWI-exception Swift-exception Texinfo-exception u-boot-exception-2.0 UBDL-exception Universal-FOSS-exception-1.0 vsftpd-openssl-exception WxWindows-exception-3.1 x11vnc-openssl-exception"
    ).split()
}
TAGS = ("spdx-license-identifier:", "spdx-license-expression:", "license-expression:")
PHRASES = {
    "mit license": "MIT", "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "apache license, version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache.org/licenses/license-2.0": "Apache-2.0",
    "gnu general public license, version 2": "GPL-2.0", "gnu general public license, version 3": "GPL-3.0", "gnu general public license version 2": "GPL-2.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license v2": "GPL-2.0", "gnu general public license v3": "GPL-3.0",
    "gnu lesser general public license, version 3": "LGPL-3.0", "gnu lesser general public license version 3": "LGPL-3.0", "gnu lesser general public license, version 2.1": "LGPL-2.1", "gnu lesser general public license version 2.1": "LGPL-2.1",
    "gnu affero general public license": "AGPL-3.0", "mozilla public license, version 2.0": "MPL-2.0", "mozilla public license version 2.0": "MPL-2.0", "mozilla public license, v. 2.0": "MPL-2.0",
    "eclipse public license 2.0": "EPL-2.0", "eclipse public license - v 2.0": "EPL-2.0", "boost software license": "BSL-1.0", "isc license": "ISC", "bsd 2-clause": "BSD-2-Clause", "bsd 3-clause": "BSD-3-Clause", "redistribution and use in source and binary forms": "BSD-3-Clause",
    "cc0 1.0": "CC0-1.0", "cc by 4.0": "CC-BY-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc by-nc 4.0": "CC-BY-NC-4.0", "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "cc by-nd 4.0": "CC-BY-ND-4.0", "creative commons attribution 4.0": "CC-BY-4.0",
    "all advertising materials mentioning features or use of this software": "BSD-4-Clause", "bsd 4-clause": "BSD-4-Clause", "simplified bsd license": "BSD-2-Clause", "artistic license 2.0": "Artistic-2.0", "sil open font license, version 1.1": "OFL-1.1", "sil open font license version 1.1": "OFL-1.1", "zlib license": "Zlib", "gnu free documentation license, version 1.3": "GFDL-1.3-or-later", "cc by-nd 3.0": "CC-BY-ND-3.0", "cc by 3.0": "CC-BY-3.0", "cc by-sa 3.0": "CC-BY-SA-3.0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
}
for _family, _short, _versions in (("general", "GPL", ("1", "2", "3")), ("lesser general", "LGPL", ("2.1", "3")), ("library general", "LGPL", ("2",)), ("affero general", "AGPL", ("3",))):
    for _v in _versions:
        for _comma in (",", ";", ""):
            _head, _id = f"gnu {_family} public license as published by the free software foundation{_comma}", f"{_short}-{_v}" + ".0" * ("." not in _v)
            PHRASES |= {f"{_head} either version {_v}": f"{_id}-or-later", f"{_head} version {_v}": f"{_id}-only"}
_BSD, _THIRD = "redistribution and use in source and binary forms", "neither the name"
_LEADER = re.compile(r"(?:^|\n)[ \t]*(?:/?\*+/?|//+!?|/\*+|#+|;+|%+|--+|<!--|>+|\|+|!+|\"+|dnl\b|rem\b|\.\\\")[ \t]*")
_WELL_FORMED = re.compile(r"(?:documentref-[a-z0-9.\-]+:)?(?=[a-z0-9.\-]*[0-9\-])[a-z0-9][a-z0-9.\-]*")  # a name with a digit or a hyphen
_SURE = re.compile(r"(?:documentref-[a-z0-9.\-]+:)?licenseref-.+|.+-v?\d+(?:\.\d+)*(?:-.+)?")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.\-:]+\+?")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    pass


def to_postfix(text: str) -> list[str]:
    """Shunting-yard: WITH binds tighter than AND, AND tighter than OR; all associate to the left.

    Scans as far as the text reads as an expression: operands and operators must alternate."""
    out: list[str] = []
    ops: list[str] = []
    want, at, depth = True, 0, 0  # want: an operand comes next
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        m = _TOKEN.match(text, at)
        if not m:
            break
        tok = m.group()
        low = tok.lower()
        if want:
            if tok == "(":
                ops.append(tok)
                depth += 1
            elif low in _PRECEDENCE or tok == ")":
                raise ExpressionError(f"operand expected, not {tok!r}")
            else:
                out.append(tok)
                want = False
        elif tok == ")":
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif low in _PRECEDENCE:
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            want = True
        else:
            break  # the expression is over; ordinary text follows
        at = m.end()
    if want or depth:
        raise ExpressionError("unfinished expression")
    return out + ops[::-1]


def stricter(a: int | None, b: int | None) -> int | None:
    top = len(RANKS) - 1
    return (top if top in (a, b) else None) if None in (a, b) else max(a, b)


def freer(a: int | None, b: int | None) -> int | None:
    return (0 if 0 in (a, b) else None) if None in (a, b) else min(a, b)


def evaluate(text: str) -> tuple[str, int | None, list[str]]:
    """(normal form, rank, identifiers): AND takes the stricter side, OR the freer one, and an
    exception frees copyleft to weak copyleft.  The rank is None where an unknown one decides."""
    stack: list[tuple] = []
    sure = False
    for tok in to_postfix(text):
        if tok in _PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            if tok == "with":
                if b[0] != "exception" or a[0] != "id":
                    raise ExpressionError("WITH needs a license and an exception")
                stack.append(("with", f"{a[1]} WITH {b[1]}", b[2] if b[2] is None else 2 if a[2] == 3 else a[2], a[3], 3))
                continue
            if "exception" in (a[0], b[0]):
                raise ExpressionError("an exception stands alone")
            p = _PRECEDENCE[tok]
            left, right = (f"({x[1]})" if x[4] < p else x[1] for x in (a, b))
            rank = stricter(a[2], b[2]) if tok == "and" else freer(a[2], b[2])
            stack.append((tok, f"{left} {tok.upper()} {right}", rank, a[3] + b[3], p))
        else:
            low = tok.lower()
            plus = low.endswith("+")
            low = low.rstrip("+").rstrip(".")
            if low in EXCEPTIONS and not plus:
                stack.append(("exception", EXCEPTIONS[low], 0, [], 9))
            elif low in _CANON:
                name = _CANON[low] + "+" * plus
                stack.append(("id", name, KNOWN[_CANON[low]], [name], 9))
                sure = True
            elif "-exception" in low and _WELL_FORMED.fullmatch(low) and not plus:
                stack.append(("exception", tok.rstrip("."), None, [], 9))
            elif _WELL_FORMED.fullmatch(low):
                name = tok.rstrip("+").rstrip(".") + "+" * plus
                stack.append(("id", name, None, [name], 9))
                sure |= bool(_SURE.fullmatch(low))
            else:
                raise ExpressionError(f"unknown license {tok!r}")
    (top,) = stack
    if top[0] == "exception":
        raise ExpressionError("an exception stands alone")
    if not sure:
        raise ExpressionError("no license that is known or has a version")
    return top[1], top[2], top[3]


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for t in TAGS:
        auto.add_word(t, (t, None))
    for p, i in PHRASES.items():
        auto.add_word(p, (p, i))
    auto.make_automaton()
    return auto


def scan(text: str | None, auto: ahocorasick.Automaton) -> tuple[str, str | None, list[str], str | None, int]:
    """(status, expression, identifiers, obligation, findings) of one whole text."""
    if not text:
        return "none", None, [], None, 0
    low = text.lower()
    found: dict[str, tuple[int | None, list[str]]] = {}
    hits = bad = 0
    for end, (word, ident) in auto.iter(low):
        start = end - len(word) + 1
        if ident is not None or start and low[start - 1].isalnum():
            continue
        stop = low.find("\n", end + 1)
        line = text[end + 1 : stop if stop >= 0 else len(low)] if len(text) == len(low) else low[end + 1 : stop if stop >= 0 else len(low)]
        hits += 1
        try:
            expr, rank, ids = evaluate(line.split("*/")[0].split("-->")[0])
        except ExpressionError:
            bad += 1
            continue
        found.setdefault(expr, (rank, ids))
    flat = " ".join(_LEADER.sub("\n", low).split())
    phrases: list[tuple[int, int, str]] = []  # by their ends
    for end, (word, ident) in auto.iter(flat):
        start = end - len(word) + 1
        if ident is None or start and flat[start - 1].isalnum() or end + 1 < len(flat) and flat[end + 1].isalnum():
            continue
        while phrases and phrases[-1][0] >= start:
            phrases.pop()
        if not phrases or phrases[-1][1] < end:
            phrases.append((start, end, ident))
    # the clause that all BSD licenses open with tells them apart only with another one
    named = {flat[a : e + 1]: i for a, e, i in phrases}
    if _BSD in named and _THIRD not in flat and {"BSD-2-Clause", "BSD-4-Clause"} & {i for x, i in named.items() if x != _BSD}:
        phrases = [x for x in phrases if flat[x[0] : x[1] + 1] != _BSD]
    for _, _, ident in phrases:
        hits += 1
        found.setdefault(ident, (KNOWN[ident], [ident]))
    if not found:
        return ("invalid" if bad else "none"), None, [], None, hits
    parts = sorted(found)
    expr = parts[0] if len(parts) == 1 else " AND ".join(f"({p})" if " OR " in p else p for p in parts)
    ids = sorted({i for _, x in found.values() for i in x})
    return "found", expr, ids, None if (rank := reduce(stricter, (r for r, _ in found.values()))) is None else RANKS[rank], hits


def _scan_batches(batches):
    auto = automaton()
    for b in batches:
        rows = [scan(t, auto) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32())],
            names=["doc_id", "status", "expression", "licenses", "obligation", "findings"],
        )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: (doc_id, status, expression, licenses, obligation, findings)."""
    return slim(docs, id_col, text_col).mapInArrow(_scan_batches, "doc_id long, status string, expression string, licenses array<string>, obligation string, findings int")
