"""License signatures: hand-written patterns over lower-cased text.

Each family has a label, words that mark it, and patterns from specific to general. A
pattern is tried on texts with a word that every match of it must hold. Further rules follow from an SPDX
identifier: its tag, its page's address and "licensed under" phrases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Between words of a phrase: any run of characters that aren't of a word.
_GAP = r"[^0-9a-z\x80-\xff]+"


@dataclass(frozen=True)
class Rule:
    """A signature. Of overlapping detections the one with the higher priority stays."""

    name: str
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    score: float


# label, SPDX identifiers, keywords, patterns; a space in a pattern stands for _GAP.
_FAMILIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = (
    ("gpl-2-classpath", (), ("classpath",), (r"gnu general public license version 2 with the classpath exception", r"gpl[ v-]{0,3}2 with classpath exception", r"with the classpath exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules")),
    ("gcc-exception", (), ("runtime",), (r"gnu general public license version 3 with gcc runtime library exception", r"gcc runtime library exception")),
    ("apache-2-llvm", (), ("llvm",), (r"apache license v ?2\.0 with llvm exceptions", r"under the apache license with llvm exceptions")),
    ("0bsd", ("0bsd",), ("bsd", "0bsd"), (r"bsd zero clause licen[cs]e", r"zero clause bsd(?: licen[cs]e)?", r"0 clause bsd", r"free public license 1\.0\.0")),
    ("eclipse-distribution", (), ("eclipse",), (r"eclipse distribution license v(?:ersion )?1\.0", r"eclipse distribution license")),
    ("cpal", ("cpal-1.0",), ("attribution",), (r"common public attribution license version 1\.0", r"common public attribution license")),
    ("ms-lpl", (), ("limited",), (r"microsoft limited public license", r"microsoft reference source license")),
    ("mit", ("mit", "mit-0", "x11"), ("mit",), (r"permission is hereby granted free of charge to any person obtaining a copy", r"the software is provided as is without warranty of any kind express or implied", r"the mit license mit", r"mit x11 license", r"expat license", r"the mit license", r"mit licen[cs]ed?")),
    ("apache-2", ("apache-2.0",), ("apache",), (r"apache license version 2(?:\.0)?", r"apache license 2(?:\.0)?", r"apache 2(?:\.0)? licen[cs]ed?", r"apache software license 2(?:\.0)?", r"asl 2(?:\.0)?", r"apache-2(?:\.0)?")),
    ("apache-1", ("apache-1.0", "apache-1.1"), ("apache",), (r"apache software license version 1\.[01]", r"apache license version 1\.[01]", r"apache license 1\.[01]")),
    ("gpl-3", ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"), ("gnu", "gpl"), (r"gnu general public license version 3(?:\.0)?", r"gnu general public license v ?3", r"gnu gpl v(?:ersion )?3", r"gpl[ v-]{0,3}3(?:\.0)?", r"general public license as published by the free software foundation either version 3")),
    ("gpl-2", ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"), ("gnu", "gpl"), (r"gnu general public license version 2(?:\.0)?", r"gnu general public license v ?2", r"gnu gpl v(?:ersion )?2", r"gpl[ v-]{0,3}2(?:\.0)?", r"general public license as published by the free software foundation either version 2")),
    ("gpl-1", ("gpl-1.0",), ("gnu", "gpl"), (r"gnu general public license version 1", r"gpl[ v-]{0,3}1\.0")),
    ("gpl", (), ("gnu", "gpl"), (r"gnu general public license", r"gnu gpl", r"under the gpl")),
    ("lgpl-3", ("lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"), ("lgpl", "lesser"), (r"gnu lesser general public license version 3", r"gnu lesser general public license v ?3", r"lgpl[ v-]{0,3}3(?:\.0)?")),
    ("lgpl-2.1", ("lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"), ("lgpl", "lesser"), (r"gnu lesser general public license version 2\.1", r"gnu lesser general public license v ?2\.1", r"lgpl[ v-]{0,3}2\.1")),
    ("lgpl-2", ("lgpl-2.0", "lgpl-2.0-only"), ("lgpl", "library"), (r"gnu library general public license version 2", r"lgpl[ v-]{0,3}2\.0")),
    ("lgpl", (), ("lgpl", "lesser", "library"), (r"gnu lesser general public license", r"gnu library general public license", r"gnu lgpl", r"under the lgpl")),
    ("agpl-3", ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"), ("agpl", "affero"), (r"gnu affero general public license version 3", r"gnu affero general public license v ?3", r"agpl[ v-]{0,3}3(?:\.0)?")),
    ("agpl", (), ("agpl", "affero"), (r"gnu affero general public license", r"affero gpl", r"under the agpl")),
    ("fdl", ("gfdl-1.1", "gfdl-1.2", "gfdl-1.3"), ("fdl", "documentation"), (r"gnu free documentation license version 1\.[0-3]", r"gnu free documentation license", r"gnu fdl")),
    ("bsd-2-clause", ("bsd-2-clause",), ("bsd",), (r"2 clause bsd licen[cs]e", r"bsd 2 clause", r"simplified bsd licen[cs]e", r"freebsd licen[cs]e", r"two clause bsd")),
    ("bsd-3-clause", ("bsd-3-clause",), ("bsd", "redistribution"), (r"3 clause bsd licen[cs]e", r"bsd 3 clause", r"new bsd licen[cs]e", r"modified bsd licen[cs]e", r"revised bsd licen[cs]e", r"three clause bsd", r"neither the name of [^.]{1,120} nor the names of its contributors")),
    ("bsd-4-clause", ("bsd-4-clause",), ("bsd", "advertising"), (r"bsd 4 clause", r"original bsd licen[cs]e", r"all advertising materials mentioning features or use of this software")),
    ("bsd", (), ("bsd", "redistribution"), (r"redistribution and use in source and binary forms with or without modification", r"bsd style licen[cs]e", r"bsd licen[cs]ed?")),
    ("isc", ("isc",), ("isc", "permission"), (r"isc licen[cs]e", r"permission to use copy modify and or distribute this software for any purpose")),
    ("mpl-2", ("mpl-2.0",), ("mozilla", "mpl"), (r"mozilla public license version 2(?:\.0)?", r"mozilla public license v ?2", r"mpl[ v-]{0,3}2(?:\.0)?")),
    ("mpl-1.1", ("mpl-1.1", "mpl-1.0"), ("mozilla", "mpl"), (r"mozilla public license version 1\.[01]", r"mpl[ v-]{0,3}1\.[01]")),
    ("epl-2", ("epl-2.0",), ("eclipse", "epl"), (r"eclipse public license v(?:ersion )?2(?:\.0)?", r"eclipse public license 2(?:\.0)?", r"epl[ v-]{0,3}2(?:\.0)?")),
    ("epl-1", ("epl-1.0",), ("eclipse", "epl"), (r"eclipse public license v(?:ersion )?1(?:\.0)?", r"eclipse public license 1(?:\.0)?", r"epl[ v-]{0,3}1(?:\.0)?")),
    ("cddl", ("cddl-1.0", "cddl-1.1"), ("cddl", "development"), (r"common development and distribution license", r"cddl[ v-]{0,3}1\.[01]")),
    ("cpl", ("cpl-1.0",), ("common public",), (r"common public license version 1(?:\.0)?", r"common public license")),
    ("artistic-2", ("artistic-2.0",), ("artistic",), (r"artistic license version 2(?:\.0)?", r"artistic license 2(?:\.0)?")),
    ("artistic-1", ("artistic-1.0",), ("artistic",), (r"artistic license version 1(?:\.0)?", r"the artistic license")),
    ("boost", ("bsl-1.0",), ("boost",), (r"boost software license version 1\.0", r"boost software license")),
    ("zlib", ("zlib",), ("zlib",), (r"zlib libpng licen[cs]e", r"zlib licen[cs]e")),
    ("unlicense", ("unlicense",), ("unlicense", "unencumbered"), (r"this is free and unencumbered software released into the public domain", r"the unlicense")),
    ("wtfpl", ("wtfpl",), ("wtfpl", "what the"), (r"do what the f[a-z*]{1,5} you want to public license", r"wtfpl")),
    ("cc0", ("cc0-1.0",), ("cc0", "public domain"), (r"cc0 1(?:\.0)?(?: universal)?", r"creative commons zero", r"public domain dedication", r"cc0 licen[cs]e")),
    ("cc-by-nc-nd", ("cc-by-nc-nd-4.0", "cc-by-nc-nd-3.0"), ("cc", "noncommercial"), (r"cc by nc nd(?: [1-4]\.0)?", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s", r"attribution noncommercial noderiv(?:ative)?s")),
    ("cc-by-nc-sa", ("cc-by-nc-sa-4.0", "cc-by-nc-sa-3.0"), ("cc", "noncommercial"), (r"cc by nc sa(?: [1-4]\.0)?", r"creative commons attribution non ?commercial share ?alike", r"attribution noncommercial sharealike")),
    ("cc-by-nc", ("cc-by-nc-4.0", "cc-by-nc-3.0"), ("cc", "noncommercial"), (r"cc by nc(?: [1-4]\.0)?", r"creative commons attribution non ?commercial", r"attribution noncommercial [1-4]\.0")),
    ("cc-by-nd", ("cc-by-nd-4.0", "cc-by-nd-3.0"), ("cc", "noderiv"), (r"cc by nd(?: [1-4]\.0)?", r"creative commons attribution no ?deriv(?:ative)?s")),
    ("cc-by-sa", ("cc-by-sa-4.0", "cc-by-sa-3.0"), ("cc", "sharealike", "share alike"), (r"cc by sa(?: [1-4]\.0)?", r"creative commons attribution share ?alike", r"attribution sharealike [1-4]\.0")),
    ("cc-by", ("cc-by-4.0", "cc-by-3.0", "cc-by-2.0"), ("cc", "creative commons"), (r"cc by [1-4]\.0", r"creative commons attribution(?: [1-4]\.0)?(?: international)?")),
    ("cc", (), ("creative commons", "creativecommons"), (r"creative commons licen[cs]e", r"under a creative commons")),
    ("odbl", ("odbl-1.0",), ("odbl", "open data"), (r"open data commons open database license", r"open database license", r"odbl[ v-]{0,3}1\.0")),
    ("odc-by", ("odc-by-1.0",), ("open data", "odc"), (r"open data commons attribution license", r"odc by(?: 1\.0)?")),
    ("pddl", ("pddl-1.0",), ("pddl", "open data"), (r"open data commons public domain dedication", r"pddl 1\.0")),
    ("ogl", ("ogl-uk-1.0", "ogl-uk-2.0", "ogl-uk-3.0"), ("open government",), (r"open government licen[cs]e v(?:ersion )?[1-3](?:\.0)?", r"open government licen[cs]e")),
    ("ofl", ("ofl-1.0", "ofl-1.1"), ("ofl", "font license"), (r"sil open font license version 1\.1", r"sil open font license", r"open font license")),
    ("eupl", ("eupl-1.1", "eupl-1.2"), ("eupl", "european union"), (r"european union public licen[cs]e v(?:ersion )?[. ]?1\.[12]", r"european union public licen[cs]e", r"eupl[ v-]{0,3}1\.[12]")),
    ("ms-pl", ("ms-pl",), ("ms-pl", "microsoft public"), (r"microsoft public license", r"ms pl")),
    ("ms-rl", ("ms-rl",), ("ms-rl", "microsoft reciprocal"), (r"microsoft reciprocal license", r"ms rl")),
    ("python", ("psf-2.0", "python-2.0"), ("python software",), (r"python software foundation license version 2", r"python software foundation license")),
    ("php", ("php-3.0", "php-3.01"), ("php",), (r"php license version 3\.0?1?", r"the php license")),
    ("postgresql", ("postgresql",), ("postgresql",), (r"postgresql licen[cs]e",)),
    ("openssl", ("openssl",), ("openssl",), (r"openssl licen[cs]e", r"openssl toolkit licen[cs]e")),
    ("ecl", ("ecl-2.0",), ("educational community",), (r"educational community license version 2\.0", r"educational community license")),
    ("afl", ("afl-3.0",), ("academic free",), (r"academic free license v(?:ersion )?[123]\.[01]", r"academic free license")),
    ("osl", ("osl-3.0",), ("open software license",), (r"open software license v(?:ersion )?[123]\.[01]", r"open software license")),
    ("ncsa", ("ncsa",), ("ncsa",), (r"university of illinois ncsa open source license", r"ncsa open source license")),
    ("vim", ("vim",), ("vim license",), (r"vim license",)),
    ("bsl-1.1", ("busl-1.1",), ("business source",), (r"business source license 1\.1", r"business source license")),
    ("sspl", ("sspl-1.0",), ("server side public", "sspl"), (r"server side public license v(?:ersion )?1", r"server side public license", r"under the sspl")),
    ("elastic-2", ("elastic-2.0",), ("elastic license",), (r"elastic license 2\.0", r"elastic license")),
    ("rail", (), ("rail", "responsible ai"), (r"(?:creativeml |bigscience )?open rail m licen[cs]e", r"responsible ai licen[cs]e", r"open rail")),
    ("public-domain", (), ("public domain",), (r"dedicated to the public domain", r"released into the public domain", r"in the public domain", r"this work is public domain")),
    ("all-rights-reserved", (), ("rights reserved",), (r"all rights reserved", r"some rights reserved")),
    ("lppl", ("lppl-1.3c",), ("latex", "lppl"), (r"latex project public license version 1\.3[abc]?", r"latex project public license", r"lppl version 1\.3[abc]?", r"lppl 1\.[0-3][abc]?")),
    ("cecill", ("cecill-2.1", "cecill-b", "cecill-c"), ("cecill",), (r"cecill free software license agreement", r"cecill licen[cs]e agreement", r"licence cecill", r"cecill [bc] licen[cs]e", r"cecill[ v-]{0,3}2\.[01]")),
    ("mulan", ("mulanpsl-2.0",), ("mulan",), (r"mulan permissive software license v ?[12]", r"mulan permissive software license", r"mulan psl v ?[12]", r"mulan public license v ?[12]")),
    ("upl", ("upl-1.0",), ("permissive",), (r"universal permissive license v(?:ersion )?1\.0", r"universal permissive license")),
    ("w3c", ("w3c",), ("w3c",), (r"w3c software and document notice and license", r"w3c software notice and license", r"w3c document license", r"w3c test suite license")),
    ("libpng", ("libpng-2.0",), ("libpng", "png"), (r"png reference library license version 2", r"png reference library license", r"libpng licen[cs]e")),
    ("ijg", ("ijg",), ("jpeg",), (r"independent jpeg group licen[cs]e", r"based in part on the work of the independent jpeg group")),
    ("freetype", ("ftl",), ("freetype",), (r"the freetype project licen[cs]e", r"freetype licen[cs]e", r"portions of this software are copyright of the freetype project")),
    ("hpnd", ("hpnd",), ("disclaimer",), (r"historical permission notice and disclaimer",)),
    ("sleepycat", ("sleepycat",), ("sleepycat",), (r"sleepycat public licen[cs]e", r"sleepycat licen[cs]e")),
    ("qpl", ("qpl-1.0",), ("qpl",), (r"the q public license version 1\.0", r"q public license", r"qpl[ v-]{0,3}1\.0")),
    ("rpl", ("rpl-1.5",), ("reciprocal",), (r"reciprocal public license version 1\.[15]", r"reciprocal public license 1\.[15]", r"reciprocal public license")),
    ("apsl", ("apsl-2.0",), ("apple",), (r"apple public source license version [12]\.[0-2]", r"apple public source license")),
    ("sun", ("sissl", "spl-1.0"), ("sun", "industry"), (r"sun industry standards source license", r"sun public license version 1\.0", r"sun public license")),
    ("ipl", ("ipl-1.0",), ("ibm",), (r"ibm public license version 1\.0", r"ibm public license")),
    ("intel", ("intel",), ("intel",), (r"intel open source license", r"intel simplified software license")),
    ("nvidia", (), ("nvidia",), (r"nvidia open model license", r"nvidia source code license", r"nvidia software license agreement")),
    ("beerware", ("beerware",), ("beer", "beerware"), (r"the beer ware license", r"beerware licen[cs]e", r"you can buy me a beer in return")),
    ("json", ("json",), ("evil", "json"), (r"the software shall be used for good not evil", r"the json license")),
    ("fair", ("fair",), ("instrument", "fair"), (r"usage of the works is permitted provided that this instrument is retained", r"the fair license")),
    ("cern-ohl", ("cern-ohl-s-2.0", "cern-ohl-w-2.0", "cern-ohl-p-2.0"), ("cern",), (r"cern open hardware licen[cs]e version [12](?:\.[0-9])?", r"cern open hardware licen[cs]e v ?[12](?:\.[0-9])?", r"cern open hardware licen[cs]e", r"cern ohl")),
    ("tapr", ("tapr-ohl-1.0",), ("tapr",), (r"tapr open hardware license version 1\.0", r"tapr open hardware license", r"tapr noncommercial hardware license")),
    ("solderpad", ("shl-2.1",), ("solderpad",), (r"solderpad hardware licen[cs]e version [0-2]\.[0-9]+", r"solderpad hardware licen[cs]e")),
    ("cdla", ("cdla-permissive-2.0", "cdla-sharing-1.0"), ("cdla", "data"), (r"community data license agreement permissive version [12]\.0", r"community data license agreement sharing version 1\.0", r"community data license agreement", r"cdla permissive [12]\.0", r"cdla sharing 1\.0")),
    ("commons-clause", (), ("clause",), (r"commons clause license condition v ?1\.0", r"subject to the commons clause", r"commons clause")),
    ("polyform", ("polyform-noncommercial-1.0.0", "polyform-small-business-1.0.0"), ("polyform",), (r"polyform noncommercial license(?: 1\.0\.0)?", r"polyform small business license(?: 1\.0\.0)?", r"polyform strict license(?: 1\.0\.0)?", r"polyform shield license(?: 1\.0\.0)?")),
    ("parity", ("parity-7.0.0",), ("parity", "prosperity"), (r"the parity public license 7\.0\.0", r"parity public license", r"prosperity public license 3\.0\.0", r"prosperity public license")),
    ("source-available", (), ("confluent", "timescale", "redis", "community"), (r"confluent community license", r"timescale license agreement", r"redis source available license", r"cockroach community license", r"functional source license")),
    ("llama", (), ("llama",), (r"llama [234](?:\.[0-9])? community license agreement", r"llama [234](?:\.[0-9])? community license", r"llama [234](?:\.[0-9])? acceptable use policy", r"built with meta llama")),
    ("gemma", (), ("gemma",), (r"gemma terms of use", r"gemma prohibited use policy")),
    ("etalab", ("etalab-2.0",), ("ouverte", "etalab"), (r"licence ouverte open licen[cs]e", r"licence ouverte", r"etalab 2\.0")),
    ("nasa", ("nasa-1.3",), ("nasa",), (r"nasa open source agreement version 1\.3", r"nasa open source agreement")),
    ("fsf-all-permissive", ("fsfap",), ("medium",), (r"copying and distribution of this file with or without modification are permitted in any medium without royalty",)),
    ("bzip2", ("bzip2-1.0.6",), ("bzip2",), (r"bzip2 and libbzip2 licen[cs]e", r"bzip2 licen[cs]e")),
    ("unicode", ("unicode-3.0", "icu"), ("unicode", "icu"), (r"unicode inc license agreement data files and software", r"unicode license v ?3", r"unicode license agreement", r"icu license")),
    ("tcl", ("tcl",), ("tcl",), (r"tcl tk licen[cs]e", r"tcl licen[cs]e")),
    ("ruby", ("ruby",), ("ruby",), (r"under the same terms as ruby", r"ruby licen[cs]e")),
    ("perl", (), ("perl",), (r"under the same terms as perl", r"perl artistic licen[cs]e")),
    ("zpl", ("zpl-2.1",), ("zope",), (r"zope public license version 2\.[01]", r"zope public license")),
    ("blue-oak", ("blueoak-1.0.0",), ("oak",), (r"blue oak model license 1\.0\.0", r"blue oak model license")),
    ("hippocratic", (), ("hippocratic",), (r"hippocratic license version [1-3]\.[0-9]", r"hippocratic license")),
    ("anti-capitalist", (), ("capitalist",), (r"anti capitalist software license",)),
    ("noncommercial", (), ("commercial", "noncommercial", "academic", "research"), (r"for non ?commercial use only", r"for non ?commercial research purposes only", r"free for non ?commercial use", r"may not be used for commercial purposes", r"for academic use only", r"for research purposes only")),
    ("evaluation", (), ("evaluation",), (r"for evaluation purposes only", r"evaluation license agreement")),
    ("shareware", (), ("shareware", "freeware"), (r"this program is shareware", r"this software is shareware", r"freeware licen[cs]e", r"this software is freeware")),
    ("eula", (), ("agreement", "user"), (r"end user licen[cs]e agreement", r"by installing this software you agree to the terms of this agreement")),
    ("no-training", (), ("training", "train"), (r"may not be used to train", r"may not be used for training", r"no part of this work may be used to train", r"text and data mining reserved")),
    ("proprietary", (), ("proprietary", "confidential"), (r"proprietary and confidential", r"confidential and proprietary", r"unauthorized copying of this file via any medium is strictly prohibited")),
)
# Phrases of the contract's base labels: label, words.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

def _compiled(pattern: str) -> re.Pattern[bytes]:
    gaps = {"[ v-]": "[ v-]", " ?": f"(?:{_GAP})?", " ": _GAP}
    spaced = re.sub(r"\[ v-\]| \?| ", lambda m: gaps[m[0]], pattern)
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + spaced.encode("latin-1") + rb")(?![0-9a-z\x80-\xff])")


#: Words that say little of a license: the keyword of a pattern only if it has no other.
_COMMON = frozenset("licen license licensed public software version general open under this the and free this with for any name all you want copy work use source work what do in to of by is e a".split())


def _needed(pattern: str, words: tuple[str, ...]) -> bytes:
    """A word that every match of a hand-written pattern holds; one that marks the family if there is."""
    plain = re.sub(r"\\.", "|", pattern)
    plain = re.sub(r"\(\?:[^)]*\)\??", "|", plain)
    plain = re.sub(r"\[[^\]]*\](?:\{[^}]*\}|[?+*])?", "|", plain)
    plain = re.sub(r".\?", "|", plain)
    return max(re.findall(r"[a-z0-9]+", plain), key=lambda w: (w in words, w not in _COMMON, len(w))).encode()


def rules() -> list[Rule]:
    """All rules in order: a family's hand-written patterns, from specific to general, then those of its identifiers."""
    out: list[Rule] = []
    for rank, (label, ids, keywords, patterns) in enumerate(_FAMILIES):
        base = 1000 - 10 * rank
        for k, p in enumerate(patterns):
            out.append(Rule(f"{label}/text-{k}", label, 20_000 + base - k, (_needed(p, keywords),), _compiled(p), 0.9 if k == 0 else 0.7))
        for i in ids:
            tag = re.escape(i).replace("\\-", "-")
            out.append(Rule(f"{label}/tag-{i}", label, 40_000 + base, (b"spdx",), re.compile(rb"spdx-license-identifier:[ \t]*" + tag.encode() + rb"(?![0-9a-z.+-]*[0-9a-z])"), 1.0))
            out.append(Rule(f"{label}/page-{i}", label, 30_000 + base, (b"spdx.org/", b"opensource.org/"), re.compile(rb"(?:spdx|opensource)\.org/licenses?/" + tag.encode() + rb"(?![0-9a-z-])"), 0.95))
            name = tag.replace("-", "[ -]")
            out.append(Rule(f"{label}/phrase-{i}", label, 35_000 + base, (b"under",), re.compile(rb"(?:licen[cs]ed|released|distributed|available|published)" + _GAP.encode() + rb"under" + _GAP.encode() + rb"(?:the" + _GAP.encode() + rb"|a" + _GAP.encode() + rb")?(?:terms" + _GAP.encode() + rb"of" + _GAP.encode() + rb"the" + _GAP.encode() + rb")?" + name.encode() + rb"(?:" + _GAP.encode() + rb"licen[cs]e)?(?![0-9a-z\x80-\xff])"), 0.95))
    return out


#: The base phrases, matched as consecutive words with anything but word characters between them: label, a word that a text must hold, pattern.
BASE_PATTERNS = tuple((label, words.split()[0 if label == "apache-2" else 2].encode(), re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[^0-9a-z\x80-\xff]+".join(w.encode() for w in words.split()) + rb"(?![0-9a-z\x80-\xff])")) for label, words in BASE)
