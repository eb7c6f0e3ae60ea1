"""Licence signatures, in order of priority (earlier lines win).

A line is ``label | keyword | pattern``.  The keyword is a literal word sequence that
every match contains; it gates the pattern.  A pattern is a sequence of words matched
against lower-cased words: ``w?`` is optional, ``(a|b)`` a choice, ``*`` any one word,
``#`` a number of digits, ``x~`` a word that starts with x.  Punctuation separates words,
so ``GPL-3.0-only`` reads ``gpl 3 0 only``.
"""

from __future__ import annotations

import re

RULES = """
agpl-3.0-or-later | spdx license identifier agpl | spdx license identifier agpl 3 0 or later
agpl-3.0-only | spdx license identifier agpl | spdx license identifier agpl 3 0 only?
agpl-1.0 | spdx license identifier agpl | spdx license identifier agpl 1 0 (only|or)? later?
lgpl-3.0-or-later | spdx license identifier lgpl | spdx license identifier lgpl 3 0 or later
lgpl-3.0-only | spdx license identifier lgpl | spdx license identifier lgpl 3 0 only?
lgpl-2.1-or-later | spdx license identifier lgpl | spdx license identifier lgpl 2 1 or later
lgpl-2.1-only | spdx license identifier lgpl | spdx license identifier lgpl 2 1 only?
lgpl-2.0-or-later | spdx license identifier lgpl | spdx license identifier lgpl 2 0 or later
lgpl-2.0-only | spdx license identifier lgpl | spdx license identifier lgpl 2 0 only?
gpl-3.0-or-later | spdx license identifier gpl | spdx license identifier gpl 3 0 or later
gpl-3.0-only | spdx license identifier gpl | spdx license identifier gpl 3 0 only?
gpl-2.0-or-later | spdx license identifier gpl | spdx license identifier gpl 2 0 or later
gpl-2.0-only | spdx license identifier gpl | spdx license identifier gpl 2 0 only?
gpl-1.0-or-later | spdx license identifier gpl | spdx license identifier gpl 1 0 or later
apache-2 | spdx license identifier apache | spdx license identifier apache 2 0
apache-1.1 | spdx license identifier apache | spdx license identifier apache 1 1
mit-0 | spdx license identifier mit | spdx license identifier mit 0
mit | spdx license identifier mit | spdx license identifier mit
bsd-4-clause | spdx license identifier bsd | spdx license identifier bsd 4 clause
bsd-3-clause | spdx license identifier bsd | spdx license identifier bsd 3 clause
bsd-2-clause | spdx license identifier bsd | spdx license identifier bsd 2 clause
0bsd | spdx license identifier 0bsd | spdx license identifier 0bsd
isc | spdx license identifier isc | spdx license identifier isc
mpl-2.0 | spdx license identifier mpl | spdx license identifier mpl 2 0
mpl-1.1 | spdx license identifier mpl | spdx license identifier mpl 1 1
epl-2.0 | spdx license identifier epl | spdx license identifier epl 2 0
epl-1.0 | spdx license identifier epl | spdx license identifier epl 1 0
cddl-1.1 | spdx license identifier cddl | spdx license identifier cddl 1 1
cddl-1.0 | spdx license identifier cddl | spdx license identifier cddl 1 0
eupl-1.2 | spdx license identifier eupl | spdx license identifier eupl 1 2
unlicense | spdx license identifier unlicense | spdx license identifier unlicense
zlib | spdx license identifier zlib | spdx license identifier zlib
bsl-1.0 | spdx license identifier bsl | spdx license identifier bsl 1 0
cc0-1.0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
cc-by-4.0 | spdx license identifier cc by | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx license identifier cc by | spdx license identifier cc by sa 4 0
wtfpl | spdx license identifier wtfpl | spdx license identifier wtfpl
artistic-2.0 | spdx license identifier artistic | spdx license identifier artistic 2 0
ofl-1.1 | spdx license identifier ofl | spdx license identifier ofl 1 1
postgresql | spdx license identifier postgresql | spdx license identifier postgresql
python-2.0 | spdx license identifier python | spdx license identifier python 2 0
agpl-3.0-or-later | gnu affero general public license | gnu affero general public license as published by the free software foundation either version 3 of the license or at? your? option? any later version
agpl-3.0-only | gnu affero general public license | gnu affero general public license v? version? (3|v3|iii) 0?
agpl | gnu affero general public license | gnu affero general public license
agpl-3.0-only | agpl | agpl v? version? (3|v3|agplv3) 0? only?
agpl-3.0-only | agplv3 | agplv3
agpl | affero gpl | affero gpl
lgpl-3.0-or-later | gnu lesser general public license | gnu lesser general public license as published by the free software foundation either version 3 of the license or at? your? option? any later version
lgpl-2.1-or-later | gnu lesser general public license | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at? your? option? any later version
lgpl-3.0-only | gnu lesser general public license | gnu lesser general public license v? version? (3|v3) 0?
lgpl-2.1-only | gnu lesser general public license | gnu lesser general public license v? version? (2|v2) 1
lgpl | gnu lesser general public license | gnu lesser general public license
lgpl-2.0-only | gnu library general public license | gnu library general public license v? version? (2|v2) 0?
lgpl-2.0 | gnu library general public license | gnu library general public license
lgpl-3.0-only | lgpl 3 | lgpl 3 0? only?
lgpl-2.1-only | lgpl 2 1 | lgpl 2 1 only?
lgpl-3.0-only | lgplv3 | lgplv3
lgpl-2.1-only | lgplv2 | lgplv2 1
gpl-3.0-or-later | gnu general public license | gnu general public license as published by the free software foundation either version 3 of the license or at? your? option? any later version
gpl-2.0-or-later | gnu general public license | gnu general public license as published by the free software foundation either version 2 of the license or at? your? option? any later version
gpl-3.0-only | gnu general public license | gnu general public license version 3 0? only
gpl-2.0-only | gnu general public license | gnu general public license version 2 0? only
gpl-3.0 | gnu general public license | gnu general public license v? version? (3|v3) 0?
gpl-2.0 | gnu general public license | gnu general public license v? version? (2|v2) 0?
gpl-1.0 | gnu general public license | gnu general public license v? version? (1|v1) 0?
gpl | gnu general public license | gnu general public license
gpl-3.0 | under the gpl | under the gpl v? version? (3|v3) 0?
gpl-2.0 | under the gpl | under the gpl v? version? (2|v2) 0?
gpl | under the gpl | under the gpl
gpl-3.0 | gplv3 | (gnu)? gplv3
gpl-2.0 | gplv2 | (gnu)? gplv2
gpl-3.0-or-later | gpl 3 0 or later | gpl 3 0 or later
gpl-2.0-or-later | gpl 2 0 or later | gpl 2 0 or later
gpl-linking-exception | linking exception | (gpl|classpath|special|runtime) linking exception
classpath-exception-2.0 | classpath exception | classpath exception
gcc-exception-3.1 | gcc runtime library exception | gcc runtime library exception (version)? 3? 1?
gfdl-1.3 | gnu free documentation license | gnu free documentation license version 1 3
gfdl-1.2 | gnu free documentation license | gnu free documentation license version 1 2
gfdl | gnu free documentation license | gnu free documentation license
apache-2 | apache license version 2 | (licensed|released|distributed)? under? the? apache license version 2 0?
apache-2 | apache license 2 | apache license 2 0?
apache-2 | apache 2 | (under)? (the)? apache 2 0? (license|licence)
apache-2 | apache software license | apache software license version? 2 0?
apache-1.1 | apache software license | apache software license version? 1 1
apache-1.0 | apache software license | apache software license version? 1 0?
apache | apache software license | apache software license
apache-2 | www apache org licenses | www apache org licenses license 2 0
apache-2-llvm-exception | llvm exceptions | apache license v2 0 with llvm exceptions
apache | apache license | (the)? apache license
mit | under the mit license | (licensed|released|distributed|available)? under the mit license
mit | under the mit licence | (licensed|released|distributed|available)? under the mit licence
mit | mit license | (the)? mit license
mit | expat license | (the)? (mit)? expat license
mit | x11 license | (the)? mit? x11 license
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | mit no attribution | mit no attribution
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause | endorse or promote products | neither the name of * * * * * * * * endorse or promote products derived from this software
bsd-3-clause | neither the name of | neither the name of (the|its) * nor the names of its contributors may be used
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | 4 clause bsd | 4 clause bsd license?
bsd-3-clause | 3 clause bsd | 3 clause bsd license?
bsd-2-clause | 2 clause bsd | 2 clause bsd license?
bsd-4-clause | bsd 4 clause | bsd 4 clause license?
bsd-3-clause | bsd 3 clause | bsd 3 clause license?
bsd-2-clause | bsd 2 clause | bsd 2 clause license?
bsd-4-clause | original bsd license | original bsd license
bsd-3-clause | new bsd license | new bsd license
bsd-3-clause | modified bsd license | modified bsd license
bsd-3-clause | revised bsd license | revised bsd license
bsd-2-clause | simplified bsd license | simplified bsd license
bsd-2-clause | freebsd license | freebsd license
0bsd | zero clause bsd | zero clause bsd license?
bsd | bsd license | (the)? bsd license
bsd | bsd style license | bsd style license
isc | isc license | (the)? isc license
isc | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | the author disclaims all warranties | the software is provided as is and the author disclaims all warranties
mpl-2.0 | mozilla public license | (subject to the terms of)? the? mozilla public license (v|version)? 2 0
mpl-1.1 | mozilla public license | the? mozilla public license version? 1 1
mpl-1.0 | mozilla public license | the? mozilla public license version? 1 0
mpl | mozilla public license | the? mozilla public license
mpl-2.0 | mozilla org mpl 2 0 | mozilla org mpl 2 0
mpl-2.0 | mpl 2 0 | mpl 2 0
epl-2.0 | eclipse public license | eclipse public license (v|version)? (2|v2) 0?
epl-1.0 | eclipse public license | eclipse public license (v|version)? (1|v1) 0?
epl | eclipse public license | eclipse public license
edl-1.0 | eclipse distribution license | eclipse distribution license (v|version)? 1? 0?
cpl-1.0 | common public license | common public license (v|version)? 1? 0?
ipl-1.0 | ibm public license | ibm public license (v|version)? 1? 0?
cddl-1.1 | common development and distribution license | common development and distribution license (v|version)? 1 1
cddl-1.0 | common development and distribution license | common development and distribution license (v|version)? 1? 0?
eupl-1.2 | european union public licence | european union public licence (v|version)? 1 2
eupl-1.1 | european union public licence | european union public licence (v|version)? 1 1
eupl | european union public licence | european union public licence
eupl | eupl | (the)? eupl
cecill-2.1 | cecill | cecill (v|version)? 2 1
cecill-b | cecill b | cecill b license?
cecill-c | cecill c | cecill c license?
cecill | cecill | cecill license?
osl-3.0 | open software license | open software license (v|version)? 3 0
osl-2.1 | open software license | open software license (v|version)? 2 1
afl-3.0 | academic free license | academic free license (v|version)? 3 0
afl-2.1 | academic free license | academic free license (v|version)? 2 1
artistic-2.0 | artistic license | (the)? artistic license (v|version)? 2 0?
artistic-1.0 | artistic license | (the)? artistic license (v|version)? 1 0?
artistic | artistic license | (the)? artistic license
bsl-1.0 | boost software license | boost software license (v|version)? 1? 0?
busl-1.1 | business source license | business source license (v|version)? 1? 1?
elastic-2.0 | elastic license | elastic license (v|version)? 2? 0?
sspl-1.0 | server side public license | server side public license (v|version)? 1? 0?
commons-clause | commons clause | commons clause license? condition?
zlib | zlib license | (the)? zlib (libpng)? license
zlib | this software is provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | libpng license | libpng license version? 2?
libtiff | libtiff license | libtiff license
openssl | openssl license | (the)? openssl license
ssleay | ssleay license | (original)? ssleay license
curl | curl license | (the)? curl license
ncsa | university of illinois ncsa | university of illinois ncsa open source license
php-3.01 | php license | (the)? php license version? 3 01
php | php license | (the)? php license
python-2.0 | python software foundation license | python software foundation license version? 2?
python | python license | (the)? python license
ruby | ruby license | (the)? ruby license
perl | same terms as perl | (under)? (the)? same terms as perl itself
postgresql | postgresql license | (the)? postgresql license
unicode | unicode license agreement | unicode license agreement
unicode | unicode inc license | unicode inc license agreement data files and software
icu | icu license | (the)? icu license
w3c | w3c software notice and license | w3c software notice and license
w3c | w3c software and document | w3c software and document notice and? license
ofl-1.1 | sil open font license | sil open font license (v|version)? 1? 1?
unlicense | this is free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | unlicense org | (the)? unlicense org
unlicense | the unlicense | the unlicense
wtfpl | do what the fuck you want | do what the fuck you want to public license
wtfpl | wtfpl | (the)? wtfpl
beerware | beer ware license | beer ware license
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
apsl-2.0 | apple public source license | apple public source license (v|version)? 2? 0?
npl-1.1 | netscape public license | netscape public license (v|version)? 1? 1?
qpl-1.0 | q public license | q public license (v|version)? 1? 0?
vim | vim license | (the)? vim license
zpl-2.1 | zope public license | zope public license (v|version)? 2? 1?
sleepycat | sleepycat license | (the)? sleepycat license
ecl-2.0 | educational community license | educational community license (v|version)? 2? 0?
upl-1.0 | universal permissive license | universal permissive license (v|version)? 1? 0?
blueoak-1.0.0 | blue oak model license | blue oak model license 1? 0? 0?
mulan-2.0 | mulan permissive software license | mulan permissive software license (v|version)? (2|v2)?
hpnd | historical permission notice and disclaimer | historical permission notice and disclaimer
odbl-1.0 | open database license | open database license (v|version)? 1? 0?
odc-by-1.0 | open data commons attribution license | open data commons attribution license (v|version)? 1? 0?
pddl-1.0 | public domain dedication and license | (odc)? public domain dedication and license
cdla-permissive-2.0 | community data license agreement | community data license agreement permissive (v|version)? 2 0
cdla-permissive-1.0 | community data license agreement | community data license agreement permissive (v|version)? 1? 0?
cdla-sharing-1.0 | community data license agreement | community data license agreement sharing (v|version)? 1? 0?
openrail-m | openrail m | (creativeml)? (bigscience)? openrail m license?
rail | responsible ai license | responsible ai license
cc0-1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | cc0 | cc0 1? 0? universal?
cc0-1.0 | creative commons zero | creative commons zero v? 1? 0? universal?
cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd 4 0
cc-by-nc-4.0 | creativecommons org licenses by nc | creativecommons org licenses by nc 4 0
cc-by-sa-4.0 | creativecommons org licenses by sa | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org licenses by sa | creativecommons org licenses by sa 3 0
cc-by-nd-4.0 | creativecommons org licenses by nd | creativecommons org licenses by nd 4 0
cc-by-4.0 | creativecommons org licenses by 4 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org licenses by 3 | creativecommons org licenses by 3 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc-4.0 | cc by nc 4 | cc by nc 4 0
cc-by-nc-3.0 | cc by nc 3 | cc by nc 3 0
cc-by-nc | cc by nc | cc by nc
cc-by-sa-4.0 | cc by sa | cc by sa 4 0
cc-by-sa-3.0 | cc by sa | cc by sa 3 0
cc-by-sa | cc by sa | cc by sa
cc-by-nd | cc by nd | cc by nd (4|3)? 0?
cc-by-4.0 | cc by 4 0 | cc by 4 0
cc-by-3.0 | cc by 3 0 | cc by 3 0
cc-by | cc by | licensed? under cc by
cc-by-nc-sa | attribution noncommercial sharealike | creative? commons? attribution noncommercial sharealike (4|3)? 0? international? unported? license?
cc-by-nc-nd | attribution noncommercial noderivatives | creative? commons? attribution noncommercial noderivatives (4|3)? 0? international? license?
cc-by-nc | attribution noncommercial | creative? commons? attribution noncommercial (4|3)? 0? international? unported? license?
cc-by-sa | attribution sharealike | creative? commons? attribution sharealike (4|3)? 0? international? unported? license?
cc-by-nd | attribution noderivatives | creative? commons? attribution noderivatives (4|3)? 0? international? license?
cc-by | creative commons attribution | creative commons attribution (4|3)? 0? international? unported? license?
creative-commons | creative commons license | (a)? creative commons license
public-domain | public domain | (released|dedicated|placed) (in|into|to) the public domain
all-rights-reserved | all rights reserved | all rights reserved
proprietary | proprietary and confidential | proprietary and confidential
proprietary | may not be reproduced | may not be reproduced or? (distributed|transmitted) * * * * * written permission
"""

#: The contract's phrases: never suppressed.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

WORD_CHARS = r"[^ ]"


def _unit(word: str) -> str:
    """One word of a pattern; words of the text stand between two spaces each."""
    optional, word = word.endswith("?"), word.removesuffix("?")
    if word == "*":
        body = WORD_CHARS + "+"
    elif word == "#":
        body = "[0-9]+"
    elif word.endswith("~"):
        body = re.escape(word[:-1]) + WORD_CHARS + "*"
    elif word.startswith("("):
        body = "(?:" + "|".join(map(re.escape, word[1:-1].split("|"))) + ")"
    else:
        body = word
    return f"(?: {body} )?" if optional else f" {body} "


def compile_rule(pattern: str) -> str:
    """A regular expression that Java, RE2 and Python read alike.  A parenthesised choice
    holds single words; an optional phrase is written word by word."""
    words = re.findall(r"\([^)]*\)\??|\S+", pattern)
    out = []
    for w in words:
        inner = w.removesuffix("?")
        if inner.startswith("(") and " " in inner:
            phrase = "".join(_unit(x) for x in inner[1:-1].split())
            out.append(f"(?:{phrase})?" if w.endswith("?") else phrase)
        else:
            out.append(_unit(w))
    return "".join(out)


def spaced(words: str) -> str:
    return "".join(f" {w} " for w in words.split())


def rules() -> list[tuple[int, str, str, str]]:
    """(order, label, keyword as spaced words, regular expression)."""
    out = []
    for line in RULES.strip().splitlines():
        label, keyword, pattern = (x.strip() for x in line.split("|", 2))
        out.append((len(out) + 1, label, spaced(keyword), compile_rule(pattern)))
    return out
