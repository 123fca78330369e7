"""Signature rules of licence texts, matched against a text's words joined by one space.

Each family below is written by hand: a label, a pattern of its name, of its SPDX identifier, of its address, and a
word that every match holds. A family makes a rule in each of the forms in FORMS. CLAUSES are rules of their own: headers,
grants and conditions that stand in a licence's text. Earlier forms and lines come first: identifiers and addresses, then
clauses, then notices and names.
"""

from __future__ import annotations

from dataclasses import dataclass

# One licence family a line, as label | name | identifier | address | word.
FAMILIES = r"""
agpl-3.0 | gnu affero general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?|affero gpl ?v?3 | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0 | agpl|affero
agpl-1.0 | affero general public license(?: version| v)? 1(?: 0)? | agpl 1 0(?: only| or later)? | affero org oagpl | agpl|affero
lgpl-3.0 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0 | lgpl|lesser
lgpl-2.1 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses(?: old licenses)? lgpl 2 1 | lgpl|lesser
lgpl-2.0 | gnu library general public license(?: version| v)? ?2(?: 0)? | lgpl 2 0(?: only| or later)? | gnu org licenses old licenses lgpl 2 0 | lgpl|library
gpl-3.0 | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?|gplv3 | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0 | gpl|gplv3|gnu
gpl-2.0 | gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?|gplv2 | gpl 2 0(?: only| or later)? | gnu org licenses(?: old licenses)? gpl 2 0 | gpl|gplv2|gnu
gpl-1.0 | gnu general public license(?: version| v)? ?1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses old licenses gpl 1 0 | gpl|gnu
gfdl-1.3 | gnu free documentation license(?: version| v)? ?1 3 | gfdl 1 3(?: only| or later)? | gnu org licenses fdl 1 3 | gfdl|gnu
gfdl-1.2 | gnu free documentation license(?: version| v)? ?1 2 | gfdl 1 2(?: only| or later)? | gnu org licenses(?: old licenses)? fdl 1 2 | gfdl|gnu
apache-2.0 | apache (?:software )?license(?: version| v)? ?2(?: 0)? | apache 2 0 | apache org licenses license 2 0 | apache
apache-1.1 | apache (?:software )?license(?: version| v)? ?1 1 | apache 1 1 | apache org licenses license 1 1 | apache
apache-1.0 | apache (?:software )?license(?: version| v)? ?1 0 | apache 1 0 | apache org licenses license 1 0 | apache
mit | mit license|expat license|permission is hereby granted free of charge to any person obtaining a copy of this software | mit | opensource org licenses? mit | mit license|expat license|permission
mit-0 | mit no attribution | mit 0 | github com aws mit 0 | mit no
x11 | x11 license|mit x11 license | x11 | xfree86 org current license | x11
bsd-4-clause | (?:bsd )?4 clause (?:original )?bsd(?: license)?|all advertising materials mentioning features or use of this software must display | bsd 4 clause | directory fsf org wiki license bsd 4clause | bsd|advertising
bsd-3-clause | (?:new|modified|revised|3 clause) bsd license|bsd 3 clause(?: new or revised)?(?: license)?|redistribution and use in source and binary forms with or without modification are permitted | bsd 3 clause | opensource org licenses? bsd 3 clause | bsd|redistribution
bsd-2-clause | (?:simplified|freebsd|2 clause) bsd license|bsd 2 clause(?: simplified)?(?: license)? | bsd 2 clause | opensource org licenses? bsd 2 clause | bsd
0bsd | zero clause bsd(?: license)?|bsd zero clause license | 0bsd | opensource org licenses? 0bsd | bsd|0bsd
isc | isc license|permission to use copy modify and or distribute this software for any purpose | isc | opensource org licenses? isc | isc|permission
mpl-2.0 | mozilla public license(?: version| v)? ?2(?: 0)? | mpl 2 0 | mozilla org mpl 2 0 | mpl|mozilla
mpl-1.1 | mozilla public license(?: version| v)? ?1 1 | mpl 1 1 | mozilla org mpl 1 1 | mpl|mozilla
mpl-1.0 | mozilla public license(?: version| v)? ?1 0 | mpl 1 0 | mozilla org mpl 1 0 | mpl|mozilla
epl-2.0 | eclipse public license(?: version| v)? ?2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0 | epl|eclipse
epl-1.0 | eclipse public license(?: version| v)? ?1(?: 0)? | epl 1 0 | eclipse org legal epl v10 | epl|eclipse
edl-1.0 | eclipse distribution license(?: version| v)? ?1(?: 0)? | edl 1 0 | eclipse org org documents edl v10 | edl|eclipse
cddl-1.1 | common development and distribution license(?: cddl)?(?: version| v)? ?1 1 | cddl 1 1 | glassfish java net public cddl | cddl|distribution
cddl-1.0 | common development and distribution license(?: cddl)?(?: version| v)? ?1(?: 0)? | cddl 1 0 | opensource org licenses? cddl 1 0 | cddl|distribution
cpl-1.0 | common public license(?: version| v)? ?1(?: 0)? | cpl 1 0 | opensource org licenses? cpl 1 0 | cpl|public
ipl-1.0 | ibm public license(?: version| v)? ?1(?: 0)? | ipl 1 0 | opensource org licenses? ipl 1 0 | ipl|ibm
artistic-2.0 | artistic license(?: version| v)? ?2(?: 0)? | artistic 2 0 | perlfoundation org artistic license 2 0 | artistic
artistic-1.0 | artistic license(?: version| v)? ?1(?: 0)? | artistic 1 0(?: perl| cl8)? | opensource org licenses? artistic 1 0 | artistic
boost-1.0 | boost software license(?: version| v)? ?1(?: 0)? | bsl 1 0 | boost org license 1 0 | boost|bsl
zlib | zlib license|zlib libpng license|this software is provided as is without any express or implied warranty | zlib | zlib net zlib license | zlib|implied
libpng | libpng license|png reference library license | libpng(?: 2 0)? | libpng org pub png src libpng license | libpng|png
unlicense | (?:this is free and unencumbered software released into|the) unlicense(?: license)?|free and unencumbered software released into the public domain | unlicense | unlicense org | unlicense|unencumbered
wtfpl | do what the fuck you want to public license | wtfpl | wtfpl net | wtfpl|fuck
cc0-1.0 | creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?|cc0(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0 | cc0|creative
cc-by-nc-nd-4.0 | creative commons attribution non ?commercial no ?derivatives(?: works)? 4 0|cc by nc nd 4 0 | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0 | cc|creative
cc-by-nc-nd-3.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 3 0|cc by nc nd 3 0 | cc by nc nd 3 0 | creativecommons org licenses by nc nd 3 0 | cc|creative
cc-by-nc-sa-4.0 | creative commons attribution non ?commercial share ?alike 4 0|cc by nc sa 4 0 | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0 | cc|creative
cc-by-nc-sa-3.0 | creative commons attribution non ?commercial share ?alike 3 0|cc by nc sa 3 0 | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0 | cc|creative
cc-by-nc-4.0 | creative commons attribution non ?commercial 4 0|cc by nc 4 0 | cc by nc 4 0 | creativecommons org licenses by nc 4 0 | cc|creative
cc-by-nc-3.0 | creative commons attribution non ?commercial 3 0|cc by nc 3 0 | cc by nc 3 0 | creativecommons org licenses by nc 3 0 | cc|creative
cc-by-nd-4.0 | creative commons attribution no ?derivatives(?: works)? 4 0|cc by nd 4 0 | cc by nd 4 0 | creativecommons org licenses by nd 4 0 | cc|creative
cc-by-sa-4.0 | creative commons attribution share ?alike 4 0|cc by sa 4 0 | cc by sa 4 0 | creativecommons org licenses by sa 4 0 | cc|creative
cc-by-sa-3.0 | creative commons attribution share ?alike 3 0|cc by sa 3 0 | cc by sa 3 0 | creativecommons org licenses by sa 3 0 | cc|creative
cc-by-4.0 | creative commons attribution 4 0|cc by 4 0 | cc by 4 0 | creativecommons org licenses by 4 0 | cc|creative
cc-by-3.0 | creative commons attribution 3 0|cc by 3 0 | cc by 3 0 | creativecommons org licenses by 3 0 | cc|creative
cc-by-2.0 | creative commons attribution 2 0|cc by 2 0 | cc by 2 0 | creativecommons org licenses by 2 0 | cc|creative
odbl-1.0 | open (?:data commons open )?database license(?: odbl)?(?: version| v)?(?: 1 0)? | odbl 1 0 | opendatacommons org licenses odbl | odbl|database
odc-by-1.0 | open data commons attribution license(?: version| v)?(?: 1 0)? | odc by 1 0 | opendatacommons org licenses by | commons
pddl-1.0 | public domain dedication and license|open data commons public domain | pddl 1 0 | opendatacommons org licenses pddl | dedication|commons
ofl-1.1 | sil open font license(?: version| v)?(?: 1 1)? | ofl 1 1(?: rfn| no rfn)? | scripts sil org ofl | ofl|sil
eupl-1.2 | european union public licen[cs]e(?: version| v)? ?1 2 | eupl 1 2 | joinup ec europa eu collection eupl | eupl|european
eupl-1.1 | european union public licen[cs]e(?: version| v)? ?1 1 | eupl 1 1 | ec europa eu idabc eupl | eupl|european
osl-3.0 | open software license(?: version| v)? ?3(?: 0)? | osl 3 0 | opensource org licenses? osl 3 0 | osl|software
afl-3.0 | academic free license(?: version| v)? ?3(?: 0)? | afl 3 0 | opensource org licenses? afl 3 0 | afl|academic
ms-pl | microsoft public license | ms pl | opensource org licenses? ms pl | microsoft
ms-rl | microsoft reciprocal license | ms rl | opensource org licenses? ms rl | microsoft
python-2.0 | python software foundation license(?: version| v)?(?: 2(?: 0)?)? | (?:python|psf) 2 0 | python org psf license | python|psf
php-3.01 | php license(?: version| v)? ?3 01 | php 3 01 | php net license 3 01 | php
postgresql | postgresql licen[cs]e | postgresql | postgresql org about licence | postgresql
openssl | openssl license|openssl toolkit license | openssl | openssl org source license | openssl
ncsa | university of illinois ncsa open source license | ncsa | opensource org licenses? ncsa | ncsa
zpl-2.1 | zope public license(?: version| v)? ?2 1 | zpl 2 1 | opensource org licenses? zpl 2 1 | zpl|zope
vim | vim license | vim | vimdoc sourceforge net htmldoc uganda | vim
json | json license|the software shall be used for good not evil | json | json org license | json|evil
bsl-1.1 | business source license(?: version| v)?(?: 1 1)? | busl 1 1 | mariadb com bsl11 | busl|business|mariadb
sspl-1.0 | server side public license(?: version| v)?(?: 1(?: 0)?)? | sspl 1 0 | mongodb com licensing server side public license | sspl|server
elastic-2.0 | elastic license(?: version| v)?(?: 2(?: 0)?)? | elastic 2 0 | elastic co licensing elastic license | elastic
public-domain | (?:released|placed|dedicated) (?:in|into|to) the public domain|public domain mark 1 0 | public domain | creativecommons org publicdomain mark 1 0 | domain|publicdomain
all-rights-reserved | all rights reserved | proprietary | rightsstatements org vocab inc | reserved|proprietary
"""

# The forms of a rule, best evidence first, as form | template | score. {n} name, {i} identifier, {u} address.
FORMS = r"""
identifier | spdx license identifier (?:{i}) | 1.0
address | (?:https? )?(?:www )?(?:{u}) | 0.95
notice | (?:licensed|released|distributed|available|provided|published|covered|governed) (?:to you )?(?:under|by)(?: the)?(?: terms of)?(?: the)? (?:{n}) | 0.9
name | (?:{n}) | 0.7
"""


# Clauses of licence texts, one a line, as label | pattern | words that every match holds. A clause's score is 0.85.
CLAUSES = r"""
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license | free software you can
gpl | you should have received a copy of the gnu general public license along with this (?:program|library|file) | received a copy of the gnu
gpl | this program is distributed in the hope that it will be useful but without any warranty | in the hope that
gpl | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed | verbatim copies
gpl | the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change | freedom to share
gpl-2.0 | either version 2 of the license or at your option any later version | any later version
gpl-3.0 | either version 3 of the license or at your option any later version | any later version
gpl-3.0 | patent license under the contributor s essential patent claims | essential patent claims
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license | free software you can
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with this library | received a copy of the gnu
lgpl | a program that contains no derivative of any portion of the library but is designed to work with the library | derivative of any portion
agpl | if you modify the program your modified version must prominently offer all users interacting with it remotely | prominently offer
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | terms of the gnu
gfdl | with no invariant sections no front cover texts and no back cover texts | no invariant sections
apache-2.0 | you may not use this file except in compliance with the license you may obtain a copy of the license at | compliance with the license
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis | applicable law
apache-2.0 | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license | irrevocable copyright license|irrevocable patent license
apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements | asf under
apache-1.1 | this product includes software developed by the apache software foundation | apache software foundation
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | permission notice
mit | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute | deal in the software
mit | in no event shall the authors or copyright holders be liable for any claim damages or other liability | copyright holders be liable
mit-0 | to deal in the software without restriction .{0,200}?and to permit persons to whom the software is furnished to do so the software is provided as is | deal in the software
bsd-2-clause | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | redistributions of source
bsd-2-clause | redistributions in binary form must reproduce the above copyright notice this list of conditions | redistributions in binary
bsd-3-clause | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products | used to endorse
bsd-4-clause | this product includes software developed by the university of california berkeley and its contributors | university of california
isc | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted | hereby granted
isc | the author disclaims all warranties with regard to this software including all implied warranties | disclaims all warranties
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | altered source versions
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software | must not be misrepresented
boost-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation | hereby granted
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | anyone is free to copy
unlicense | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest | jurisdictions that recognize
wtfpl | you just do what the fuck you want to | fuck you want
cc0-1.0 | to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights | waived all copyright
cc-by | you are free to share copy and redistribute the material in any medium or format | any medium or format
cc-by | you must give appropriate credit provide a link to the license and indicate if changes were made | appropriate credit
cc-by-nc | you may not use the material for commercial purposes | for commercial purposes
cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material | if you remix
cc-by-sa | if you remix transform or build upon the material you must distribute your contributions under the same license | if you remix
mpl-2.0 | this source code form is subject to the terms of the mozilla public license | mozilla public license
mpl-1.1 | the contents of this file are subject to the mozilla public license | mozilla public license
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license | eclipse public license
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license | common development and distribution
artistic-2.0 | you may distribute verbatim copies of the source form of the standard version of this package | verbatim copies
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied | the intent of this document
ofl-1.1 | the fonts (?:and derivatives )?(?:however )?(?:can|may) be bundled embedded redistributed and or sold | the fonts
ofl-1.1 | no modified version of the font software may use the reserved font name | font software
odbl-1.0 | any rights in individual contents of the database are licensed under the database contents license | database contents license
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | openssl project
php-3.01 | this product includes php software freely available from | php software
python-2.0 | psf hereby grants licensee a nonexclusive royalty free world wide license | psf hereby
ms-pl | if you bring a patent claim against any contributor over patents that you claim are infringed by the software | bring a patent claim
bsl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use | licensor hereby
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service | functionality of the program
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service | hosted or managed
json | the software shall be used for good | shall be used for good
public-domain | this (?:work|file|software) (?:is|has been) (?:in|placed in|released into) the public domain | public domain
all-rights-reserved | no part of this (?:publication|book|document|work) may be reproduced (?:stored (?:in a retrieval system )?)?or transmitted | reproduced stored|reproduced or transmitted
all-rights-reserved | unauthorized (?:copying|reproduction|use|distribution) of this (?:file|material|document|software) (?:via any medium )?is strictly prohibited | strictly prohibited
"""


@dataclass(frozen=True)
class Rule:
    """priority: its place among the rules. keywords: a match holds one of these words."""

    priority: int
    label: str
    form: str
    pattern: str
    keywords: tuple[str, ...]
    score: float


def rules() -> list[Rule]:
    """All families in all forms and the clauses; patterns match whole words."""
    split = lambda text: [[p.strip() for p in line.split(" | ")] for line in text.strip().splitlines()]
    out: list[Rule] = []

    def add(label: str, form: str, body: str, words: tuple[str, ...], score: float) -> None:
        out.append(Rule(len(out), label, form, f"(?<= )(?:{body})(?= )", words, score))

    for form, template, score in split(FORMS):
        if form == "notice":
            for label, body, words in split(CLAUSES):
                add(label, "clause", body, tuple(words.split("|")), 0.85)
        for label, name, identifier, address, words in split(FAMILIES):
            words = ("spdx",) if form == "identifier" else (address.split()[0],) if form == "address" else tuple(words.split("|"))
            add(label, form, template.replace("{n}", name).replace("{i}", identifier).replace("{u}", address), words, float(score))
    return out
