"""License detection by ordered signature rules behind a keyword prefilter, with containment suppression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom import ship
from tagloom.llm.common import FOLD, runs, text_chunks

#: Bytes of words, after folding A-Z: digits, a-z and every byte of a longer character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: The phrases whose words must stand consecutively, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Hand-written signatures as (label, keyword, pattern), the more exact ones of a license first. Words are parted by one space.
NAMES = [
    ("agpl-3.0-or-later", "affero", r"(?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: of the licen[cs]e)? or (?:any |at your option any )?later(?: version)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?(?! \d)"),
    ("agpl-1.0", "affero", r"affero general public licen[cs]e (?:version |v ?)?1(?: 0)?(?! \d)"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v? ?3(?: 0)?(?: only)?"),
    ("agpl", "affero", r"(?:gnu )?affero (?:general )?public licen[cs]e"),
    ("agpl", "agpl", r"licen[cs]ed under (?:the )?agpl"),
    ("lgpl-3.0-or-later", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?(?: of the licen[cs]e)? or (?:any |at your option any )?later(?: version)?"),
    ("lgpl-2.1-or-later", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1(?: of the licen[cs]e)? or (?:any |at your option any )?later(?: version)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?(?! \d)"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1"),
    ("lgpl-2.0", "library", r"gnu library general public licen[cs]e (?:version |v ?)?2(?: 0)?(?! \d)"),
    ("lgpl-2.1-or-later", "lgpl", r"lgpl ?v? ?2 1(?: or later| plus)"),
    ("lgpl-3.0-or-later", "lgpl", r"lgpl ?v? ?3(?: 0)?(?: or later| plus)"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v? ?2 1(?: only)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v? ?3(?: 0)?(?: only)?(?! \d)"),
    ("lgpl", "lesser", r"(?:gnu )?lesser (?:general )?public licen[cs]e"),
    ("lgpl", "library", r"gnu library (?:general )?public licen[cs]e"),
    ("lgpl", "lgpl", r"licen[cs]ed under (?:the )?lgpl"),
    ("gpl-3.0-or-later", "gnu", r"gnu (?:general )?public licen[cs]e(?: as published by the free software foundation either)? (?:version |v ?)?3(?: 0)?(?: of the licen[cs]e)? or (?:any |at your option any )?later(?: version)?"),
    ("gpl-2.0-or-later", "gnu", r"gnu (?:general )?public licen[cs]e(?: as published by the free software foundation either)? (?:version |v ?)?2(?: 0)?(?: of the licen[cs]e)? or (?:any |at your option any )?later(?: version)?"),
    ("gpl-1.0-or-later", "gnu", r"gnu (?:general )?public licen[cs]e (?:version |v ?)?1(?: 0)?(?: of the licen[cs]e)? or (?:any |at your option any )?later(?: version)?"),
    ("gpl-2.0-with-classpath-exception", "classpath", r"gnu general public licen[cs]e (?:version |v ?)?2(?: 0)? with (?:the )?(?:gnu )?classpath exception"),
    ("gpl-3.0-with-gcc-exception", "gcc", r"gcc runtime library exception(?: version 3 1)?"),
    ("gpl-2.0-with-font-exception", "font", r"gnu general public licen[cs]e (?:version |v ?)?2(?: 0)? with (?:the )?font exception"),
    ("gpl-3.0", "gnu", r"gnu (?:general )?public licen[cs]e (?:version |v ?)?3(?: 0)?(?! \d)"),
    ("gpl-2.0", "gnu", r"gnu (?:general )?public licen[cs]e (?:version |v ?)?2(?: 0)?(?! \d)"),
    ("gpl-1.0", "gnu", r"gnu (?:general )?public licen[cs]e (?:version |v ?)?1(?: 0)?(?! \d)"),
    ("gpl-3.0-or-later", "gpl", r"gpl ?v? ?3(?: 0)?(?: or later| plus)"),
    ("gpl-2.0-or-later", "gpl", r"gpl ?v? ?2(?: 0)?(?: or later| plus)"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v? ?3(?: 0)?(?: only)?(?! \d)"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v? ?2(?: 0)?(?: only)?(?! \d)"),
    ("gpl", "gnu", r"gnu (?:general )?public licen[cs]e"),
    ("gpl", "gpl", r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?gpl"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 3"),
    ("gfdl-1.2", "documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 2"),
    ("gfdl-1.1", "documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 1"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e|gnu fdl"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e (?:version |v ?)?2(?: 0)?(?! \d)"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e (?:version |v ?)?1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e (?:version |v ?)?1 0"),
    ("apache-2.0-with-llvm-exception", "llvm", r"apache(?: licen[cs]e)?(?: version| v)? 2 0 with llvm exceptions?"),
    ("apache-2.0", "apache", r"www apache org licen[cs]es licen[cs]e 2 0(?: txt| html)?"),
    ("apache-2.0", "apache", r"apache 2 0 licen[cs]ed?"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?(?! \d)"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?1 1"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?1 0"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("mpl-2.0", "mpl", r"mpl ?v? ?2(?: 0)?(?! \d)"),
    ("mpl-1.1", "mpl", r"mpl ?v? ?1 1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("npl-1.1", "netscape", r"netscape public licen[cs]e (?:version |v ?)?1 1"),
    ("npl-1.0", "netscape", r"netscape public licen[cs]e (?:version |v ?)?1 0"),
    ("npl", "netscape", r"netscape public licen[cs]e"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?(?! \d)"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?(?! \d)"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl-1.1", "distribution", r"common development and distribution licen[cs]e (?:version |v ?)?1 1"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e (?:version |v ?)?1(?: 0)?(?! \d)"),
    ("cddl", "distribution", r"common development and distribution licen[cs]e"),
    ("cddl", "cddl", r"licen[cs]ed under (?:the )?cddl"),
    ("cpl-1.0", "common", r"common public licen[cs]e (?:version |v ?)?1(?: 0)?(?! \d)"),
    ("cpl", "common", r"common public licen[cs]e"),
    ("cpal-1.0", "attribution", r"common public attribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e (?:version |v ?)?1 2"),
    ("eupl-1.1", "european", r"european union public licen[cs]e (?:version |v ?)?1 1"),
    ("eupl-1.0", "european", r"european union public licen[cs]e (?:version |v ?)?1 0"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("eupl", "eupl", r"licen[cs]ed under (?:the )?eupl"),
    ("osl-3.0", "open", r"open software licen[cs]e (?:version |v ?)?3(?: 0)?(?! \d)"),
    ("osl-2.1", "open", r"open software licen[cs]e (?:version |v ?)?2 1"),
    ("osl-2.0", "open", r"open software licen[cs]e (?:version |v ?)?2 0"),
    ("osl-1.0", "open", r"open software licen[cs]e (?:version |v ?)?1(?: 0)?(?! \d)"),
    ("osl", "open", r"open software licen[cs]e"),
    ("afl-3.0", "academic", r"academic free licen[cs]e (?:version |v ?)?3(?: 0)?(?! \d)"),
    ("afl-2.1", "academic", r"academic free licen[cs]e (?:version |v ?)?2 1"),
    ("afl-2.0", "academic", r"academic free licen[cs]e (?:version |v ?)?2 0"),
    ("afl-1.2", "academic", r"academic free licen[cs]e (?:version |v ?)?1 2"),
    ("afl-1.1", "academic", r"academic free licen[cs]e (?:version |v ?)?1 1"),
    ("afl", "academic", r"academic free licen[cs]e"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("ecl-1.0", "educational", r"educational community licen[cs]e (?:version |v ?)?1(?: 0)?"),
    ("ecl", "educational", r"educational community licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version |v ?)?2(?: 0)?(?! \d)"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:version |v ?)?1(?: 0)?(?! \d)"),
    ("artistic-1.0-clarified", "artistic", r"clarified artistic licen[cs]e"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e"),
    ("artistic-or-gpl", "perl", r"same terms as perl(?: itself)?(?: \d)*"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: (?:version |v ?)?1 1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e (?:version |v ?)?1 1"),
    ("ofl-1.0", "font", r"(?:sil )?open font licen[cs]e (?:version |v ?)?1 0"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e"),
    ("ubuntu-font-1.0", "ubuntu", r"ubuntu font licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("bitstream-vera", "bitstream", r"bitstream vera (?:fonts? )?(?:licen[cs]e|copyright)"),
    ("odbl-1.0", "database", r"(?:open data commons )?open database licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("odc-by-1.0", "commons", r"open data commons attribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("pddl-1.0", "commons", r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ("cdla-permissive-2.0", "community", r"community data licen[cs]e agreement permissive (?:version )?2(?: 0)?"),
    ("cdla-permissive-1.0", "community", r"community data licen[cs]e agreement permissive (?:version )?1(?: 0)?"),
    ("cdla-sharing-1.0", "community", r"community data licen[cs]e agreement sharing(?: (?:version )?1(?: 0)?)?"),
    ("ogl-uk-3.0", "government", r"open government licen[cs]e (?:version |v ?)?3(?: 0)?"),
    ("ogl-uk-2.0", "government", r"open government licen[cs]e (?:version |v ?)?2(?: 0)?"),
    ("ogl-uk-1.0", "government", r"open government licen[cs]e (?:version |v ?)?1(?: 0)?"),
    ("ogl", "government", r"open government licen[cs]e"),
    ("etalab-2.0", "etalab", r"(?:licence ouverte|open licen[cs]e) etalab(?: (?:version |v ?)?2(?: 0)?)?"),
    ("dl-de-by-2.0", "deutschland", r"datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("psf-2.0", "python", r"python software foundation licen[cs]e(?: agreement)?(?: (?:version |v ?)?2(?: 0)?)?"),
    ("cnri-python", "cnri", r"cnri (?:open source )?licen[cs]e agreement"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e (?:version |v ?)?2 1"),
    ("zpl-2.0", "zope", r"zope public licen[cs]e (?:version |v ?)?2 0"),
    ("zpl-1.1", "zope", r"zope public licen[cs]e (?:version |v ?)?1 1"),
    ("zpl", "zope", r"zope public licen[cs]e"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("wtfpl-2.0", "want", r"do what the fuck you want to public licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("wtfpl", "wtfpl", r"(?:licen[cs]ed|released) under (?:the )?wtfpl"),
    ("bsd-2-clause", "simplified", r"simplified bsd licen[cs]e"),
    ("bsd-2-clause", "freebsd", r"freebsd licen[cs]e"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-2-clause", "clause", r"2 clause bsd(?: licen[cs]e)?|two clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause-patent", "bsd", r"bsd 2 clause plus patent(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified) bsd licen[cs]e"),
    ("bsd-3-clause", "clause", r"bsd 3 clause(?: licen[cs]e)?|(?:3|three) clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause-clear", "clear", r"clear bsd licen[cs]e|bsd 3 clause clear(?: licen[cs]e)?"),
    ("bsd-4-clause", "clause", r"bsd 4 clause(?: licen[cs]e)?|(?:4|four) clause bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "original", r"original bsd licen[cs]e"),
    ("0bsd", "clause", r"(?:zero|0) clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?"),
    ("0bsd", "0bsd", r"0bsd"),
    ("bsd-1-clause", "clause", r"bsd 1 clause(?: licen[cs]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]ed?"),
    ("bsd", "bsd", r"(?:licen[cs]ed|released|distributed) under (?:the )?bsd"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|any|their)(?: [^ ]+)? contributors may be used to endorse or promote"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?|mit 0 licen[cs]e"),
    ("mit", "mit", r"(?:the )?mit licen[cs]ed?(?: mit)?"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit", "mit", r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of the )?mit"),
    ("mit", "opensource", r"opensource org licen[cs]es mit"),
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("x11", "x11", r"(?:mit )?x11 licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("isc", "purpose", r"permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose with or without fee is hereby granted"),
    ("hpnd", "historical", r"historical permission notice and disclaimer"),
    ("ntp", "ntp", r"ntp licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("libtiff", "libtiff", r"libtiff licen[cs]e"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "ssleay", r"original ssleay licen[cs]e"),
    ("php-3.01", "php", r"php licen[cs]e (?:version |v ?)?3 01"),
    ("php-3.0", "php", r"php licen[cs]e (?:version |v ?)?3 0"),
    ("php", "php", r"php licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e|same licen[cs]e as ruby"),
    ("tcl", "tcl", r"tcl tk licen[cs]e|tcl licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("w3c", "w3c", r"w3c software (?:notice and )?(?:and document )?licen[cs]e"),
    ("unicode", "unicode", r"unicode (?:inc )?licen[cs]e agreement(?: data files and software)?"),
    ("icu", "icu", r"icu licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("qpl-1.0", "public", r"q public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("rpl-1.5", "reciprocal", r"reciprocal public licen[cs]e(?: (?:version |v ?)?1 5)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("apsl-2.0", "apple", r"apple public source licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?"),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: (?:version |v ?)?1 3)?"),
    ("sun-1.0", "sun", r"sun public licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?"),
    ("sissl", "sun", r"sun industry standards source licen[cs]e"),
    ("spl-1.0", "server", r"sun server public licen[cs]e"),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e (?:version |v ?)?1 3c"),
    ("lppl-1.2", "latex", r"latex project public licen[cs]e (?:version |v ?)?1 2"),
    ("lppl", "latex", r"latex project public licen[cs]e"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[cs]e(?: agreement)?(?: (?:version |v ?)?2 1)?"),
    ("cecill-b", "cecill", r"cecill b(?: licen[cs]e)?"),
    ("cecill-c", "cecill", r"cecill c(?: licen[cs]e)?"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:permissive software licen[cs]e|psl)(?: v2| version 2)?"),
    ("vsl-1.0", "vovida", r"vovida software licen[cs]e"),
    ("w3c", "w3c", r"w3c document licen[cs]e"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"beer ?ware licen[cs]e|you can buy me a beer in return"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:released|dedicated|placed) (?:in)?to the public domain"),
    ("public-domain", "domain", r"(?:is|are) in the public domain"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "waiver", r"creative commons zero(?: waiver)?"),
    ("cc-pdm", "mark", r"(?:creative commons )?public domain mark(?: 1 0)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?"),
    ("bigscience-rail-1.0", "rail", r"(?:bigscience )?rail licen[cs]e(?: v1 0| version 1 0)?"),
    ("llama-community", "llama", r"llama (?:\d )*community licen[cs]e(?: agreement)?"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("proprietary", "unauthorized", r"unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|software|document)"),
    ("proprietary", "permission", r"may not be (?:reproduced|copied|distributed) without (?:the )?(?:prior |express |written )*permission"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("all-rights-reserved", "rechte", r"alle rechte vorbehalten"),
    ("all-rights-reserved", "droits", r"tous droits réservés"),
    ("all-rights-reserved", "derechos", r"todos los derechos reservados"),
]
#: Parts of Creative Commons names: code, words, and the versions there are; the tags of machine-readable notices.
CC = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    weight: float


def _rule(priority: int, label: str, keyword: str, pattern: str, weight: float) -> Rule:
    return Rule(priority, label, keyword, re.compile(f"(?<= )(?:{pattern})(?= )".encode()), weight)


def rules() -> list[Rule]:
    """All rules in order: machine-readable tags, Creative Commons by version, the hand-written signatures, and what names alone can say."""
    out = []
    for label in dict.fromkeys(n[0] for n in NAMES):
        out.append(_rule(0, label, "spdx", "spdx license identifier " + label.replace("-", " ").replace(".", " ").replace(" or later", "(?: or later| plus)"), 1.0))
    for code, words in CC:
        named, short = f"creative commons {words}", code.replace("-", " ")
        for v in CC_VERSIONS:
            number = v.replace(".", " ")
            out.append(_rule(0, f"cc-{code}-{v}", "spdx", rf"spdx license identifier cc {short} {number}", 1.0))
            out.append(_rule(1, f"cc-{code}-{v}", "creative", rf"{named}(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?(?: version| v)? {number}", 0.9))
            out.append(_rule(1, f"cc-{code}-{v}", "cc", rf"cc {short} {number}", 0.9))
            out.append(_rule(1, f"cc-{code}-{v}", "creativecommons", rf"creativecommons org licen[cs]es {short} {number}", 0.95))
        out.append(_rule(3, f"cc-{code}", "creative", rf"{named}(?: licen[cs]e)?", 0.7))
        out.append(_rule(3, f"cc-{code}", "cc", rf"cc {short}", 0.6))
    for label, keyword, pattern in NAMES:
        exact = any(c.isdigit() for c in label)
        out.append(_rule(2, label, keyword, pattern, 0.9 if exact else 0.3 if label == "all-rights-reserved" else 0.7))
    return sorted(out, key=lambda r: r.priority)  # stable: the order of NAMES within a priority


#: One of these is in every text that a rule or a base phrase can match.
ROOTS = (b"licen", b"gpl", b"spdx", b"cc by", b"creative", b"commons", *sorted({n[1].encode() for n in NAMES} - {b"gpl", b"commons"}))
_RULES: list[Rule] = []
_KEYWORDS: set[str] = set()
_BASE = [(f" {p} ".encode(), label) for p, label in BASE.items()]


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    weight: float


def detect(words: bytes) -> tuple[list[Detection], list[tuple[int, str]]]:
    """Rule detections that nothing suppresses, and the base phrases' places, in words joined and framed by single spaces.

    Rules run in order if their keyword is there. A detection whose words lie within those of one accepted before, by an
    earlier rule, goes; a rule's own detections don't overlap.
    """
    if not _RULES:
        _RULES.extend(rules())
        _KEYWORDS.update(r.keyword for r in _RULES)
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    at = lambda i: int(np.searchsorted(spaces, i, "right")) - 1  # noqa: E731  the word that starts at byte i
    base = []
    for phrase, label in _BASE:
        i = words.find(phrase)
        while i >= 0:
            base.append((at(i + 1), label))
            i = words.find(phrase, i + 1)
    there = {k: k.encode() in words for k in _KEYWORDS}
    found: list[Detection] = []
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of what is accepted: sorted starts, the furthest end up to each
    for rule in _RULES:
        if not there[rule.keyword]:
            continue
        spans = [(m.start(), m.end() - 1) for m in rule.pattern.finditer(words)]
        if not spans:
            continue
        first, last = (np.searchsorted(spaces, x, "right") - 1 for x in np.array(spans).T)
        before = np.searchsorted(starts, first, "right") - 1
        new = (before < 0) | (reach[before] < last) if len(starts) else np.ones(len(first), bool)
        if new.any():
            found += [Detection(a, b, rule.label, rule.weight) for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)]
            own = np.array(sorted((x.start, x.end) for x in found))
            starts, reach = own[:, 0], np.maximum.accumulate(own[:, 1])
    return sorted(found), sorted(base)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    for batch in batches:
        for lo, hi, codes, offsets in text_chunks(batch.column(1)):
            codes = FOLD[codes]
            start, end, row = runs(WORD[codes], offsets)
            count, at = np.bincount(row, minlength=hi - lo), np.searchsorted(row, np.arange(hi - lo + 1))
            whole, found, base = codes.tobytes(), [], []
            for k in range(hi - lo):
                text = whole[offsets[k] : offsets[k + 1]]
                if not any(r in text for r in ROOTS):
                    found.append([])
                    base.append([])
                    continue
                a, b = start[at[k] : at[k + 1]].tolist(), end[at[k] : at[k + 1]].tolist()
                d, p = detect(b" " + b" ".join([whole[i:j] for i, j in zip(a, b, strict=True)]) + b" ")
                found.append([{"first": x.start, "last": x.end, "label": x.label, "weight": x.weight} for x in d])
                base.append([{"word": w, "label": label} for w, label in p])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count.astype(np.int64)), pa.array(base, place), pa.array(found, span)], names=["id", "n_words", "base", "found"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, found) of each row: base phrases by first word, and detections by first and last word with label and weight.

    A-Z is folded; words are runs of digits, letters and characters beyond ASCII. Null and empty texts have no words.
    Texts of any length are read whole, in time that grows with their words and detections. Every row stands alone, so
    rows that repeat and null ids change nothing; other columns are not read.
    """
    ship(docs.sparkSession)
    text = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = text.mapInArrow(_scan, "id bigint, n_words bigint, base array<struct<word:bigint,label:string>>, found array<struct<first:bigint,last:bigint,label:string,weight:double>>")
    return out.withColumnRenamed("id", id_col)
