"""License scan: ordered signature rules over the word stream of a text.

A text becomes its lower-cased words joined by single spaces, so a rule is a plain regex whatever the
punctuation or line breaks between words were. A rule runs only if its keyword occurs in the text.
Detections are then resolved in the order of priority, length, start and label: one whose words lie
within those of a detection taken before is suppressed. The three base phrases are rules as well;
their places are counted before suppression and their labels are always reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD_BYTES, byte_texts, map_rows, slices, table

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label | keyword that every match contains | regex of the license's name. Each line gives a rule for the bare name, and one for a
#: grant ("licensed under ...").
NAMES = r"""
apache-1.0 | apache | apache (?:software )?(?:license )?(?:version |v ?)?1 0
apache-1.1 | apache | apache (?:software )?(?:license )?(?:version |v ?)?1 1
apache-2.0 | apache | apache (?:software )?(?:license )?(?:version |v ?)?2(?: 0)?
mit | mit license | mit license
mit | expat license | expat license
mit-0 | mit no attribution | mit no attribution(?: license)?
mit-modern | mit license modern | mit license modern variant
x11 | x11 | x11 license
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?
bsd-1-clause | bsd | (?:bsd 1 clause|1 clause bsd)(?: license)?
bsd-0-clause | bsd | (?:0bsd|zero clause bsd|bsd zero clause)(?: license)?
bsd-3-clause-clear | bsd | (?:bsd 3 clause clear|clear bsd)(?: license)?
bsd | bsd | bsd (?:style )?license
isc | isc | isc license
zlib | zlib | zlib(?: libpng)? license
libpng | libpng | libpng license(?: (?:version )?2)?
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl(?: (?:version )?2)?
bsl-1.0 | boost | boost software license(?: (?:version )?1 0)?
gpl-1.0 | gpl | gpl ?(?:version )?v?1(?: 0)?(?: only| or later)?
gpl-2.0 | gpl | gpl ?(?:version )?v?2(?: 0)?(?: only)?
gpl-2.0-or-later | gpl | gpl ?(?:version )?v?2(?: 0)?(?: or later| or any later version)
gpl-3.0 | gpl | gpl ?(?:version )?v?3(?: 0)?(?: only)?
gpl-3.0-or-later | gpl | gpl ?(?:version )?v?3(?: 0)?(?: or later| or any later version)
gpl-1.0-text | gnu general public | gnu general public license (?:version |v ?)1(?: 0)?
gpl-2.0-text | gnu general public | gnu general public license (?:version |v ?)2(?: 0)?
gpl-3.0-text | gnu general public | gnu general public license (?:version |v ?)3(?: 0)?
gpl | gnu general public | gnu general public license
lgpl-2.0 | lgpl | lgpl ?(?:version )?v?2(?: 0)?(?: only| or later)?
lgpl-2.1 | lgpl | lgpl ?(?:version )?v?2 1(?: only| or later)?
lgpl-3.0 | lgpl | lgpl ?(?:version )?v?3(?: 0)?(?: only| or later)?
lgpl-2.1-text | gnu lesser general | gnu lesser general public license (?:version |v ?)2 1
lgpl-3.0-text | gnu lesser general | gnu lesser general public license (?:version |v ?)3(?: 0)?
lgpl | gnu lesser general | gnu lesser general public license
lgpl-2.0 | gnu library general | gnu library general public license(?: (?:version |v ?)2(?: 0)?)?
agpl-1.0 | agpl | agpl ?(?:version )?v?1(?: 0)?
agpl-3.0 | agpl | agpl ?(?:version )?v?3(?: 0)?(?: only| or later)?
agpl-3.0-text | affero | gnu affero general public license(?: (?:version |v ?)3(?: 0)?)?
gfdl-1.1 | gfdl | gfdl ?(?:version )?v?1 1
gfdl-1.2 | gfdl | gfdl ?(?:version )?v?1 2
gfdl-1.3 | gfdl | gfdl ?(?:version )?v?1 3
gfdl | gnu free documentation | gnu free documentation license(?: (?:version |v ?)1 [123])?
mpl-1.0 | mozilla | mozilla public license (?:version |v ?)?1 0
mpl-1.1 | mozilla | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | mozilla | mozilla public license (?:version |v ?)?2(?: 0)?
mpl | mpl | mpl ?v?(?:1 0|1 1|2 0|2)
epl-1.0 | eclipse | eclipse public license (?:version |v ?)?1 0
epl-2.0 | eclipse | eclipse public license (?:version |v ?)?2 0
epl | epl | epl ?v?[12] 0
edl-1.0 | eclipse | eclipse distribution license(?: (?:version |v ?)?1 0)?
cddl-1.0 | common development | common development and distribution license(?: (?:version |v ?)?1 0)?
cddl-1.1 | cddl | cddl ?(?:version )?v?1 1
cddl | cddl | cddl(?: 1 0)?
cpl-1.0 | common public | common public license(?: (?:version |v ?)?1 0)?
ipl-1.0 | ibm | ibm public license(?: (?:version |v ?)?1 0)?
eupl-1.0 | eupl | eupl ?v?1 0
eupl-1.1 | eupl | eupl ?v?1 1
eupl-1.2 | eupl | eupl ?v?1 2
eupl | european union public | european union public licence(?: v ?(?:1 [012]))?
artistic-1.0 | artistic | artistic license 1 0
artistic-2.0 | artistic | artistic license (?:version )?2 0
artistic | artistic | artistic license
perl | perl | same terms as perl(?: itself)?
python-2.0 | python software foundation | python software foundation license(?: (?:version )?2)?
python-2.0 | psf license | psf license(?: (?:version )?2)?
php-3.01 | php | php license(?: (?:version )?3 0 ?1)?
ruby | ruby | ruby license
postgresql | postgresql | postgresql license
openssl | openssl | openssl license
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
ofl-1.1 | sil open font | sil open font license(?: (?:version )?1 1)?
ofl | ofl | ofl ?1 [01]
upl-1.0 | universal permissive | universal permissive license(?: (?:version |v ?)?1 0)?
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? license
afl-3.0 | academic free | academic free license(?: (?:version |v ?)?[123] [012])?
osl-3.0 | open software license | open software license(?: (?:version |v ?)?[123] [01])?
qpl-1.0 | q public license | q public license(?: (?:version )?1 0)?
sleepycat | sleepycat | sleepycat license
watcom-1.0 | watcom | sybase open watcom public license(?: 1 0)?
apsl-2.0 | apple public source | apple public source license(?: (?:version )?[12] [0-2])?
nasa-1.3 | nasa | nasa open source agreement(?: 1 3)?
cecill-2.1 | cecill | cecill(?: (?:version |v ?)?[12](?: [01])?)?
cecill-b | cecill | cecill b
cecill-c | cecill | cecill c
vim | vim | vim license
w3c | w3c | w3c software(?: notice and)? license
sspl-1.0 | server side public | server side public license(?: (?:version |v ?)?1)?
busl-1.1 | business source | business source license(?: 1 1)?
elastic-2.0 | elastic | elastic license(?: 2 0)?
commons-clause | commons | commons clause(?: license condition v1 0)?
polyform-nc-1.0 | polyform | polyform noncommercial(?: license)?(?: 1 0 0)?
polyform-sb-1.0 | polyform | polyform small business(?: license)?(?: 1 0 0)?
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0(?: universal)?)?
cc-zero | creative commons zero | creative commons zero(?: v?1 0(?: universal)?)?
cc-by-1.0 | cc by | cc by 1 0
cc-by-2.0 | cc by | cc by 2 0
cc-by-2.5 | cc by | cc by 2 5
cc-by-3.0 | cc by | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa | cc by | cc by sa(?: [1-4] [05])?
cc-by-nd | cc by | cc by nd(?: [1-4] [05])?
cc-by-nc | cc by | cc by nc(?: [1-4] [05])?
cc-by-nc-sa | cc by | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc by | cc by nc nd(?: [1-4] [05])?
cc-by-text | creative commons | creative commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-sa-text | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-nd-text | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-nc-text | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-nc-sa-text | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-nc-nd-text | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
odbl-1.0 | odbl | odbl(?: 1 0)?
odbl-1.0 | open database license | (?:open data ?commons )?open database license
odc-by-1.0 | odc by | odc by(?: 1 0)?
odc-by-1.0 | commons attribution license | open data ?commons attribution license
pddl-1.0 | pddl | pddl(?: 1 0)?
pddl-1.0 | public domain dedication | public domain dedication and license
ogl-uk-3.0 | open government licen | open government licen[cs]e(?: (?:version |v ?)?[123](?: 0)?)?
openrail | openrail | (?:creativeml )?(?:bigscience )?openrail(?: m)?(?: license)?
llama-community | llama | llama ?[234]? community license(?: agreement)?
"""

#: label | keyword | priority | regex: statements and passages of license texts.
PASSAGES = r"""
mit | permission is hereby granted | 90 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | this permission notice | 70 | the above copyright notice and this permission notice shall be included in all copies
isc | permission to use copy | 90 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use | 85 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse | 88 | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising | 92 | all advertising materials mentioning features or use of this software must display
bsd | implied warranties | 60 | provided by the copyright holders and contributors as is and any express or implied warranties
as-is | warrant | 40 | (?:provided|distributed) (?:on an )?as is(?: basis)? without (?:any )?warrant(?:y|ies) of any kind
apache-2.0 | apache | 92 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | apache | 75 | www apache org licenses license 2 0
gpl | this program is free software | 85 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | this library is free software | 88 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | affero | 88 | under the terms of the gnu affero general public license
gpl-or-later | later version | 89 | either version [23](?: 1)? of the license or (?:at your option )?any later version
gpl | www gnu org | 70 | www gnu org licenses(?: gpl(?: [23] 0)?)?
gpl | copyleft | 45 | copyleft(?: license)?
mpl-2.0 | mozilla | 92 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla | 75 | mozilla org mpl(?: 2 0)?
epl | eclipse | 75 | www eclipse org legal epl(?: v[12]0)?
zlib | origin | 88 | the origin of this software must not be misrepresented
zlib | altered | 80 | altered source versions must be plainly marked as such
unlicense | unencumbered | 92 | this is free and unencumbered software released into the public domain
unlicense | unlicense | 75 | unlicense org
wtfpl | fuck | 85 | do what the fuck you want to(?: public license)?
bsl-1.0 | boost | 75 | www boost org license 1 0(?: txt)?
cc0-1.0 | waived | 88 | has waived all copyright and related or neighboring rights
cc0-1.0 | publicdomain | 78 | creativecommons org publicdomain zero 1 0
cc-by | creativecommons | 78 | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons | 80 | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons | 80 | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons | 80 | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons | 82 | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | 82 | creativecommons org licenses by nc nd [1-4] [05]
creative-commons | creative commons | 50 | creative commons(?: license)?
public-domain | the public domain | 60 | (?:released |placed |dedicated )?(?:in|into|to) the public domain
public-domain | public domain | 40 | public domain
ofl-1.1 | scripts sil org | 70 | scripts sil org ofl
openssl | openssl | 80 | this product includes software developed by the openssl project
reserved | all rights reserved | 55 | (?:copyright|c) .{0,60}?all rights reserved
reserved | prohibited | 65 | (?:unauthori[sz]ed )?(?:copying|reproduction|redistribution|distribution) (?:of this .{1,40}? )?is (?:strictly )?prohibited
proprietary | proprietary | 65 | proprietary and confidential
proprietary | no part of this | 62 | no part of this (?:publication|work|book|document) may be reproduced
proprietary | written permission | 60 | without (?:the )?(?:express |prior )?written permission
proprietary | end user license agreement | 58 | end user license agreement
proprietary | confidential information of | 50 | confidential information of
copyright | copyright | 35 | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | copyrighted | 35 | (?:this (?:work|material) is )?copyrighted(?: material)?
non-commercial | commercial | 55 | (?:for )?non ?commercial (?:use|purposes) only
research-only | research | 55 | (?:for )?research (?:use|purposes) only
fair-use | fair use | 40 | fair use(?: notice)?
dual | dual | 50 | dual licensed(?: under)?
see-license | license | 45 | see (?:the )?(?:accompanying )?license(?: txt| md| file)?(?: file)? for (?:more )?(?:details|information|the full)
no-license | license | 45 | (?:no|without an?) (?:explicit )?license
apache-2.0 | apache | 70 | apache org licenses license 2 0(?: txt)?
mit | without restriction | 86 | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | opensource org licenses mit | 78 | opensource org licenses mit
bsd | opensource org licenses bsd | 78 | opensource org licenses bsd(?: license(?: php)?|[ ]?[0-9] clause)?
bsd | redistributions of source code | 70 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form | 70 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
apache-1.1 | apache software foundation | 84 | this product includes software developed by the apache software foundation
gpl | without even the implied warranty | 60 | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | you should have received a copy | 72 | you should have received a copy of the gnu general public license
lgpl | you should have received a copy | 74 | you should have received a copy of the gnu (?:lesser|library) general public license
agpl | you should have received a copy | 76 | you should have received a copy of the gnu affero general public license
gfdl | permission is granted to copy | 86 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
cc-by | creative commons | 84 | this work is licensed under a creative commons attribution [1-4] [05] (?:international|unported|generic) license
cc-by-sa | creative commons | 85 | this work is licensed under a creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic) license
cc-by-nc | creative commons | 85 | this work is licensed under a creative commons attribution non ?commercial [1-4] [05] (?:international|unported|generic) license
cc-by-nc-sa | creative commons | 86 | this work is licensed under a creative commons attribution non ?commercial share ?alike [1-4] [05] (?:international|unported|generic) license
cc-by | text is available under | 66 | text is available under the creative commons attribution(?: share ?alike)? license
cc0-1.0 | no rights reserved | 60 | no rights reserved
epl | this program and the accompanying materials | 86 | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl-1.0 | common development | 86 | the contents of this file are subject to the terms of the common development and distribution license
mpl-1.1 | mozilla | 86 | the contents of this file are subject to the mozilla public license version 1 1
artistic | same terms as perl | 70 | you (?:can|may) redistribute it and or modify it under the same terms as perl
bsl-1.0 | boost | 84 | distributed under the boost software license version 1 0
php-3.01 | php | 80 | this product includes php software freely available from
zlib | without any express or implied warranty | 72 | this software is provided as is without any express or implied warranty
zlib | permission is granted to anyone | 74 | permission is granted to anyone to use this software for any purpose including commercial applications
ncsa | neither the names of | 82 | neither the names of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software
unlicense | anyone is free to copy | 86 | anyone is free to copy modify publish use compile sell or distribute this software
ogl-uk-3.0 | open government | 80 | contains public sector information licensed under the open government licen[cs]e
odbl-1.0 | openstreetmap | 78 | openstreetmap contributors
proprietary | trade secrets | 55 | (?:contains )?trade secrets(?: and confidential information)?
proprietary | not for redistribution | 55 | not for redistribution
proprietary | reverse engineer | 58 | (?:may not|shall not|agree not to) (?:copy modify )?(?:decompile )?(?:disassemble )?(?:or )?reverse engineer
proprietary | single copy | 52 | you may (?:print|download) (?:a|one) single copy
reserved | permission of the publisher | 60 | without (?:the )?(?:prior )?(?:written )?permission of the publisher
reserved | copyright holder | 45 | (?:permission|consent) of the copyright holders?
non-commercial | personal use | 50 | (?:for )?personal use only
non-commercial | educational | 50 | for educational (?:use|purposes) only
non-commercial | not be used for commercial | 58 | (?:may|must|can|shall) not be used for commercial purposes
public-domain | copyright has expired | 58 | (?:its |the |whose )?copyright has expired
public-domain | dedicate | 60 | dedicates? (?:any and all copyright interest in )?(?:this|the) (?:software|work) to the public domain
attribution | attribution is required | 50 | attribution is required
spdx | spdx | 30 | spdx license identifier
"""

# Identifiers of the SPDX license list.
SPDX = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1
Apache-2.0 APL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1 CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B
CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only
GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later HPND ICU
IJG IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0+ LGPL-3.0-only
LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MIT-Modern-Variant MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA NPL-1.1 ODbL-1.0
ODC-By-1.0 OFL-1.0 OFL-1.1 OGL-UK-3.0 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby
SGI-B-2.0 Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C Watcom-1.0 WTFPL X11 Zlib ZPL-2.1
"""

GRANT = r"(?:licensed|released|distributed|available|published|provided|redistributed|shared|covered)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?"
TAG = r"spdx license identifier "


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern
    base: bool = False


def _rule(label: str, priority: int, keyword: str, regex: str, base: bool = False) -> Rule:
    return Rule(label, priority, keyword.encode(), re.compile(rf"(?<![^ ])(?:{regex})(?![^ ])".encode()), base)


def rules() -> list[Rule]:
    """All rules, those of higher priority first; base phrases are among them."""
    out = [_rule(label, 30, phrase, phrase, True) for phrase, label in BASE.items()]
    for line in NAMES.strip().splitlines():
        label, keyword, name = (x.strip() for x in line.split(" | "))
        label = label.removesuffix("-text")
        out += [_rule(label, 80, keyword, GRANT + name), _rule(label, 50, keyword, name)]
    # a plus sign is no word, so X+ reads like X: one rule for both
    for words, label in {re.sub(r"[-.+]+", " ", x.lower()).strip(): x.lower().removesuffix("+") for x in SPDX.split()}.items():
        out.append(_rule(label, 100, "spdx", TAG + words))
    for line in PASSAGES.strip().splitlines():
        label, keyword, priority, regex = (x.strip() for x in line.split(" | "))
        out.append(_rule(label, int(priority), keyword, regex))
    return sorted(out, key=lambda r: -r.priority)


def by_keyword(ordered: list[Rule]) -> dict[bytes, list[Rule]]:
    found: dict[bytes, list[Rule]] = {}
    for rule in ordered:
        found.setdefault(rule.keyword, []).append(rule)
    return found


def scan(text: bytes, gated: dict[bytes, list[Rule]]) -> dict:
    """The scan of one UTF-8 text."""
    words = text.translate(WORD_BYTES).split()
    stream = b" ".join(words)
    hits = [(m.start(), m.end(), rule) for keyword, own in gated.items() if keyword in stream for rule in own for m in rule.pattern.finditer(stream)]
    hits.sort(key=lambda h: h[0])
    at, word, base, found = 0, 0, [], []
    for start, end, rule in hits:
        word, at = word + stream.count(b" ", at, start), start
        found.append((rule.priority, end - start, word, word + stream.count(b" ", start, end), rule.label))
        if rule.base:
            base.append((word, rule.label))
    found.sort(key=lambda d: (-d[0], -d[1], d[2], d[4]))
    taken: list[tuple] = []
    starts: dict[int, int] = {}  # start word of a taken detection: its furthest last word
    for hit in found:
        if not _contained(starts, hit[2], hit[3]):
            taken.append(hit)
            starts[hit[2]] = max(hit[3], starts.get(hit[2], -1))
    doubt = 1.0
    for label in {d[4] for d in taken}:
        doubt *= 1 - max(d[0] for d in taken if d[4] == label) / 101
    base_labels = sorted({label for _, label in base})
    return {
        "n_words": len(words), "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(base_labels), "labels": ",".join(sorted({*base_labels, *(d[4] for d in taken)})), "score": 1 - doubt,
        "n_detections": len(found), "n_suppressed": len(found) - len(taken),
    }


#: No regex above spans more words than this, so containment looks back no further.
LONGEST = 200


def _contained(starts: dict[int, int], first: int, last: int) -> bool:
    return any(starts.get(s, -1) >= last for s in range(max(0, first - LONGEST), first + 1)) if starts else False


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long, n_suppressed long"


def license_scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, more columns or none; a row for each of its rows with what `scan` finds.

    A null or empty text has no words, no labels ("") and score 0. Repeated rows give repeated rows; texts of any length are read
    whole; other columns are not read; an empty table gives an empty result. Detections of equal priority and length go by start, then label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gated = by_keyword(rules())
        for batch in slices(batches, 1, 8 << 20):
            found = [scan(t, gated) for t in byte_texts(batch.column(1))]
            columns = [pa.array([f[name] for f in found], pa.int64() if kind == "long" else pa.float64() if kind == "double" else pa.string()) for name, kind in (c.split() for c in SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    return docs.select("doc_id", "text").transform(map_rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_rules": op2_license}
ORACLE: dict[str, str] = {}
