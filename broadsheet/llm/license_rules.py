"""The ordered license signatures: hand-written patterns over normalised words, each behind a keyword
that every way to match it holds as a word.

Patterns see a text as lower-case words (digits, letters) with one space before and after each, so ``2.0`` reads ``2 0``.
A rule's level says how much it tells, and goes before its place in the list: 0 an identifier or a license's own
wording, 1 a name with its version, 2 a name, 3 a mention.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    level: int
    keyword: str
    pattern: str


#: Confidence by level.
WEIGHTS = (1.0, 0.9, 0.7, 0.4)
#: Phrases every scan reports, whatever else the rules say: phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Family: label, keyword, words of the name (a pattern), versions.
_VERSIONED = [
    ("apache", "apache", "apache (?:software )?licen[sc]e", ["1.0", "1.1", "2.0"]),
    ("apache", "apache", "apache", ["1.0", "1.1", "2.0"]),
    ("gpl", "general", "(?:gnu )?general public licen[sc]e(?: gpl)?", ["1.0", "2.0", "3.0"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1.0", "2.0", "3.0"]),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e(?: lgpl)?", ["2.1", "3.0"]),
    ("lgpl", "library", "(?:gnu )?library general public licen[sc]e(?: lgpl)?", ["2.0"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2.0", "2.1", "3.0"]),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e(?: agpl)?", ["1.0", "3.0"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1.0", "3.0"]),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e", ["1.1", "1.2", "1.3"]),
    ("gfdl", "gfdl", "gfdl", ["1.1", "1.2", "1.3"]),
    ("mpl", "mozilla", "mozilla public licen[sc]e(?: mpl)?", ["1.0", "1.1", "2.0"]),
    ("mpl", "mpl", "mpl", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", "eclipse public licen[sc]e(?: epl)?", ["1.0", "2.0"]),
    ("epl", "epl", "epl", ["1.0", "2.0"]),
    ("cddl", "cddl", "cddl", ["1.0", "1.1"]),
    ("cddl", "distribution", "common development and distribution licen[sc]e(?: cddl)?", ["1.0", "1.1"]),
    ("eupl", "eupl", "eupl", ["1.0", "1.1", "1.2"]),
    ("eupl", "union", "european union public licen[sc]e(?: eupl)?", ["1.0", "1.1", "1.2"]),
    ("osl", "osl", "osl", ["1.0", "2.0", "2.1", "3.0"]),
    ("osl", "open", "open software licen[sc]e(?: osl)?", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "academic", "academic free licen[sc]e(?: afl)?", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", "artistic", "(?:perl )?artistic licen[sc]e", ["1.0", "2.0"]),
    ("cecill", "cecill", "cecill(?: licen[sc]e)?", ["1.0", "2.0", "2.1"]),
    ("ofl", "font", "(?:sil )?open font licen[sc]e(?: ofl)?", ["1.0", "1.1"]),
    ("boost", "boost", "boost software licen[sc]e", ["1.0"]),
    ("psf", "psf", "psf(?: licen[sc]e)?", ["2.0"]),
    ("psf", "python", "python software foundation licen[sc]e", ["2.0"]),
    ("php", "php", "php licen[sc]e", ["3.0", "3.01"]),
    ("zpl", "zope", "zope public licen[sc]e", ["1.1", "2.0", "2.1"]),
    ("odbl", "odbl", "odbl", ["1.0"]),
    ("odbl", "database", "open (?:data commons open )?database licen[sc]e(?: odbl)?", ["1.0"]),
    ("lppl", "lppl", "lppl", ["1.0", "1.1", "1.2", "1.3c"]),
    ("lppl", "latex", "latex project public licen[sc]e(?: lppl)?", ["1.0", "1.1", "1.2", "1.3c"]),
    ("cpl", "common", "common public licen[sc]e(?: cpl)?", ["1.0"]),
    ("ipl", "ibm", "ibm public licen[sc]e", ["1.0"]),
    ("apsl", "apple", "apple public source licen[sc]e", ["1.0", "1.1", "1.2", "2.0"]),
    ("upl", "universal", "universal permissive licen[sc]e", ["1.0"]),
    ("mulan-psl", "mulan", "mulan (?:psl|permissive software licen[sc]e)", ["1.0", "2.0"]),
    ("bsl", "business", "business source licen[sc]e", ["1.0", "1.1"]),
    ("sspl", "sspl", "sspl", ["1.0"]),
    ("sspl", "server", "server side public licen[sc]e", ["1.0"]),
    ("elastic", "elastic", "elastic licen[sc]e", ["1.0", "2.0"]),
]
#: Creative Commons: label, short form, long form.
_COMMONS = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
]
_COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: Names without a version, and wordings: label, level, keyword, pattern.
_PLAIN = [
    ("mit", 0, "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 0, "noninfringement", "fitness for a particular purpose and noninfringement"),
    ("mit", 2, "mit", "(?:the )?mit licen[sc]ed?"),
    ("mit", 2, "mit", "licen[sc]ed under (?:the )?mit"),
    ("mit", 2, "mit", "mit style licen[sc]e"),
    ("mit", 2, "expat", "expat licen[sc]e"),
    ("x11", 2, "x11", "x11 licen[sc]e"),
    ("mit-0", 1, "mit", "mit no attribution"),
    ("bsd-text", 0, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 0, "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 0, "advertising", "all advertising materials mentioning features or use of this software"),
    ("bsd-0-clause", 1, "0bsd", "0bsd"),
    ("bsd-0-clause", 1, "bsd", "(?:zero|0) clause bsd"),
    ("bsd-1-clause", 1, "bsd", "(?:one|1) clause bsd"),
    ("bsd-2-clause", 1, "bsd", "(?:two|2) clause bsd"),
    ("bsd-3-clause", 1, "bsd", "(?:three|3) clause bsd"),
    ("bsd-4-clause", 1, "bsd", "(?:four|4) clause bsd"),
    ("bsd-2-clause", 1, "bsd", "bsd (?:two|2) clause"),
    ("bsd-3-clause", 1, "bsd", "bsd (?:three|3) clause"),
    ("bsd-4-clause", 1, "bsd", "bsd (?:four|4) clause"),
    ("bsd-2-clause", 1, "bsd", "simplified bsd"),
    ("bsd-2-clause", 1, "freebsd", "freebsd licen[sc]e"),
    ("bsd-3-clause", 1, "bsd", "(?:new|modified|revised) bsd"),
    ("bsd-4-clause", 1, "bsd", "(?:original|old) bsd licen[sc]e"),
    ("bsd", 2, "bsd", "bsd (?:style )?licen[sc]ed?"),
    ("bsd", 2, "bsd", "licen[sc]ed under (?:the |a )?bsd"),
    ("isc", 0, "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", 2, "isc", "isc licen[sc]e"),
    ("zlib", 0, "altered", "altered source versions must be plainly marked as such"),
    ("zlib", 2, "zlib", "zlib (?:libpng )?licen[sc]e"),
    ("apache-2.0", 0, "apache", "www apache org licenses license 2 0"),
    ("apache", 2, "apache", "apache (?:software )?licen[sc]ed?"),
    ("apache", 2, "apache", "licen[sc]ed (?:to|under) (?:the )?apache"),
    ("gpl-or-later", 0, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl-or-later", 0, "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("agpl-or-later", 0, "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl-2.0", 1, "gplv2", "gplv2"), ("gpl-3.0", 1, "gplv3", "gplv3"), ("gpl-2.0", 1, "gpl2", "gpl2"), ("gpl-3.0", 1, "gpl3", "gpl3"),
    ("lgpl-2.0", 1, "lgplv2", "lgplv2"), ("lgpl-2.1", 1, "lgplv2", "lgplv2 1"), ("lgpl-3.0", 1, "lgplv3", "lgplv3"), ("agpl-3.0", 1, "agplv3", "agplv3"),
    ("gpl", 2, "gpl", "gnu gpl"), ("gpl", 2, "general", "gnu general public licen[sc]e"), ("gpl", 3, "general", "general public licen[sc]e"),
    ("lgpl", 2, "lesser", "lesser general public licen[sc]e"), ("lgpl", 2, "library", "library general public licen[sc]e"),
    ("lgpl", 2, "lgpl", "lgpl"), ("agpl", 2, "affero", "affero general public licen[sc]e"), ("agpl", 2, "agpl", "agpl"), ("gpl", 3, "gpl", "gpl"),
    ("gpl-classpath-exception", 1, "classpath", "classpath exception"), ("gpl-linking-exception", 1, "linking", "linking exception"),
    ("mpl-2.0", 0, "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl", 2, "mozilla", "mozilla public licen[sc]e"), ("epl", 2, "eclipse", "eclipse public licen[sc]e"),
    ("edl", 1, "eclipse", "eclipse distribution licen[sc]e"), ("cddl", 2, "distribution", "common development and distribution licen[sc]e"),
    ("cc0-1.0", 0, "cc0", "cc0 1 0(?: universal)?"), ("cc0-1.0", 1, "cc0", "cc0"), ("cc0-1.0", 1, "zero", "creative commons zero"),
    ("cc", 2, "commons", "creative commons"), ("cc", 2, "creativecommons", "creativecommons org"),
    ("public-domain", 1, "domain", "dedicated to the public domain"), ("public-domain", 1, "domain", "released into the public domain"),
    ("public-domain", 2, "domain", "in the public domain"), ("public-domain", 3, "domain", "public domain"),
    ("unlicense", 0, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 1, "unlicense", "(?:the )?unlicense"),
    ("wtfpl", 1, "wtfpl", "wtfpl"), ("wtfpl", 0, "want", "do what the fuck you want to public licen[sc]e"),
    ("beerware", 1, "beerware", "beerware(?: licen[sc]e)?"), ("beerware", 1, "beer", "beer ware licen[sc]e"),
    ("boost", 2, "boost", "boost (?:software )?licen[sc]e"), ("ofl", 2, "font", "open font licen[sc]e"), ("ofl", 2, "sil", "sil ofl"),
    ("artistic", 2, "artistic", "artistic licen[sc]e"), ("perl", 1, "perl", "same terms as perl(?: itself)?"),
    ("ruby", 2, "ruby", "ruby licen[sc]e"), ("psf", 2, "python", "python software foundation licen[sc]e"), ("php", 2, "php", "php licen[sc]e"),
    ("openssl", 1, "openssl", "openssl licen[sc]e"), ("ssleay", 1, "ssleay", "ssleay licen[sc]e"),
    ("postgresql", 1, "postgresql", "postgresql licen[sc]e"), ("ncsa", 1, "ncsa", "ncsa open source licen[sc]e"), ("ncsa", 2, "ncsa", "ncsa licen[sc]e"),
    ("ms-pl", 1, "microsoft", "microsoft public licen[sc]e"), ("ms-rl", 1, "microsoft", "microsoft reciprocal licen[sc]e"),
    ("json", 0, "evil", "shall be used for good not evil"), ("json", 1, "json", "json licen[sc]e"), ("vim", 1, "vim", "vim licen[sc]e"),
    ("tcl", 1, "tcl", "tcl tk licen[sc]e"), ("w3c", 1, "w3c", "w3c software (?:notice and )?licen[sc]e"), ("unicode", 1, "unicode", "unicode licen[sc]e"),
    ("icu", 1, "icu", "icu licen[sc]e"), ("curl", 1, "curl", "curl licen[sc]e"), ("imagemagick", 1, "imagemagick", "imagemagick licen[sc]e"),
    ("libpng", 1, "libpng", "libpng licen[sc]e"), ("libtiff", 1, "libtiff", "libtiff licen[sc]e"), ("ijg", 1, "jpeg", "independent jpeg group licen[sc]e"),
    ("bzip2", 1, "bzip2", "bzip2 licen[sc]e"), ("freetype", 1, "freetype", "freetype (?:project )?licen[sc]e"), ("intel", 2, "intel", "intel open source licen[sc]e"),
    ("nvidia", 2, "nvidia", "nvidia (?:software )?licen[sc]e"), ("sleepycat", 1, "sleepycat", "sleepycat licen[sc]e"), ("qpl", 1, "q", "q public licen[sc]e"),
    ("naist", 1, "naist", "naist licen[sc]e"), ("hpnd", 1, "historical", "historical permission notice and disclaimer"),
    ("openrail", 1, "openrail", "openrail(?: m)?"), ("llama", 1, "llama", "llama (?:2|3|3 1|3 2)? ?community licen[sc]e"),
    ("commons-clause", 1, "clause", "commons clause"), ("polyform", 1, "polyform", "polyform (?:noncommercial|small business|shield|strict) licen[sc]e"),
    ("odc-by", 1, "commons", "open data commons attribution licen[sc]e"), ("pddl", 1, "commons", "open data commons public domain dedication"),
    ("odbl", 2, "odbl", "odbl"), ("cdla-permissive", 1, "community", "community data licen[sc]e agreement permissive"),
    ("cdla-sharing", 1, "community", "community data licen[sc]e agreement sharing"), ("ogl-uk", 1, "government", "open government licen[sc]e"),
    ("etalab", 1, "ouverte", "licence ouverte"), ("dl-de", 1, "datenlizenz", "datenlizenz deutschland"),
    ("proprietary", 1, "confidential", "proprietary and confidential"), ("proprietary", 1, "confidential", "confidential and proprietary"),
    ("proprietary", 1, "unauthorized", "unauthorized (?:copying|reproduction|use|distribution)"),
    ("proprietary", 2, "license", "end user license agreement"), ("proprietary", 2, "licence", "end user licence agreement"), ("proprietary", 2, "eula", "eula"),
    ("proprietary", 2, "prohibited", "(?:is )?strictly prohibited"),
    ("proprietary", 2, "consent", "without (?:the )?(?:prior )?(?:express )?written consent"),
    ("proprietary", 2, "permission", "without (?:the )?(?:prior )?(?:express )?written permission"),
    ("reserved", 2, "reserved", "all rights reserved"), ("reserved", 3, "reserved", "(?:some|no) rights reserved"), ("reserved", 2, "rechte", "alle rechte vorbehalten"),
    ("reserved", 2, "droits", "tous droits r[eé]serv[eé]s"), ("reserved", 2, "derechos", "todos los derechos reservados"),
    ("copyright", 3, "copyright", "copyright(?: c)?(?: (?:19|20)[0-9][0-9])?"), ("copyright", 3, "copyrighted", "copyrighted"),
    ("license", 3, "license", "license agreement"), ("license", 3, "licence", "licence agreement"), ("license", 3, "licensed", "licensed under"),
    ("license", 3, "licenced", "licenced under"), ("license", 3, "license", "license terms"), ("license", 3, "licence", "licence terms"),
    ("license", 3, "license", "(?:this|the) license"), ("license", 3, "licence", "(?:this|the) licence"),
]
#: Identifiers as machines write them (https://spdx.org/licenses): label; dashes and dots are spaces once normalised.
_IDENTIFIERS = [
    "mit", "mit-0", "isc", "zlib", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "apache-1.1", "apache-2.0", "gpl-2.0-only", "gpl-2.0-or-later",
    "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later", "agpl-3.0-only", "agpl-3.0-or-later",
    "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "cddl-1.0", "eupl-1.2", "osl-3.0", "afl-3.0", "artistic-2.0", "bsl-1.0", "busl-1.1", "unlicense", "wtfpl",
    "cc0-1.0", "cc-by-3.0", "cc-by-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "ofl-1.1",
    "psf-2.0", "python-2.0", "php-3.01", "ruby", "vim", "ncsa", "postgresql", "openssl", "ms-pl", "ms-rl", "x11", "odbl-1.0", "pddl-1.0", "upl-1.0",
]


def _words(name: str) -> str:
    return name.replace("-", " ").replace(".", " ")


def _version(version: str) -> str:
    whole, _, part = version.partition(".")
    number = f"v?{whole}(?: 0)?" if part == "0" else f"v?{whole} {part}"
    return f"(?: licen[sc]e)?(?: version)?(?: v)? {number}"


def build() -> list[Rule]:
    """All rules in order; those of one level suppress one another by extent, then by this order."""
    rules = [Rule(i, 0, "identifier", f"spdx license identifier {_words(i)}") for i in _IDENTIFIERS]
    rules += [Rule(f"{label}-{v}", 1, keyword, name + _version(v)) for label, keyword, name, versions in _VERSIONED for v in versions]
    rules += [Rule(f"{label}-{v}", 1, "cc", f"cc {short} {_words(v)}") for label, short, _ in _COMMONS for v in _COMMONS_VERSIONS]
    rules += [Rule(f"{label}-{v}", 1, "commons", f"creative commons {long}(?: international| unported| generic)?(?: public)?(?: licen[sc]e)? {_words(v)}")
              for label, _, long in _COMMONS for v in _COMMONS_VERSIONS]
    rules += [Rule(label, 2, "cc", f"cc {short}") for label, short, _ in _COMMONS]
    rules += [Rule(label, 2, "commons", f"creative commons {long}") for label, _, long in _COMMONS]
    rules += [Rule(*r) for r in _PLAIN]
    return rules
