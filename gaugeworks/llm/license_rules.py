"""Signature rules of licenses, in order. A line is `label | keywords | regex`.

Regexes run on a text's words, lower-cased and joined by single blanks (so `GPL-2.0+` reads `gpl 2 0`), and match whole
words. Every match holds all keywords of its rule as words; a rule runs only on texts that have them.
CLASSES is in order of priority: passages of license texts and machine-readable tags, notices that grant under a named
license, names with a version or an address, names alone, and hints.
"""

#: Certainty of a class.
CLASSES = {"text": 1.0, "notice": 0.95, "version": 0.85, "name": 0.7, "hint": 0.5}

_GRANT = r"(?:licen[sc]ed|released|distributed|available|published|redistributed|provided|made available|covered|governed|offered|shared|usable)(?: (?:to you|only|solely|here|freely|as is))? (?:under|by|subject to|pursuant to|in accordance with|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: an?)?"
_ID = r"spdx license identifier(?: [a-z0-9]+){0,6}?"

TEXT = rf"""
apache-2.0 | spdx apache | {_ID} apache 2 0
apache-1.1 | spdx apache | {_ID} apache 1 1
mit | spdx mit | {_ID} mit
mit-0 | spdx mit | {_ID} mit 0
bsd-2-clause | spdx bsd | {_ID} bsd 2 clause
bsd-3-clause | spdx bsd | {_ID} bsd 3 clause
bsd-4-clause | spdx bsd | {_ID} bsd 4 clause
0bsd | spdx 0bsd | {_ID} 0bsd
isc | spdx isc | {_ID} isc
gpl-1.0 | spdx gpl | {_ID} gpl 1 0(?: only| or later)?
gpl-2.0 | spdx gpl | {_ID} gpl 2 0(?: only)?
gpl-2.0-or-later | spdx gpl later | {_ID} gpl 2 0 or later
gpl-3.0 | spdx gpl | {_ID} gpl 3 0(?: only)?
gpl-3.0-or-later | spdx gpl later | {_ID} gpl 3 0 or later
lgpl-2.0 | spdx lgpl | {_ID} lgpl 2 0(?: only| or later)?
lgpl-2.1 | spdx lgpl | {_ID} lgpl 2 1(?: only)?
lgpl-2.1-or-later | spdx lgpl later | {_ID} lgpl 2 1 or later
lgpl-3.0 | spdx lgpl | {_ID} lgpl 3 0(?: only)?
lgpl-3.0-or-later | spdx lgpl later | {_ID} lgpl 3 0 or later
agpl-3.0 | spdx agpl | {_ID} agpl 3 0(?: only)?
agpl-3.0-or-later | spdx agpl later | {_ID} agpl 3 0 or later
mpl-1.1 | spdx mpl | {_ID} mpl 1 1
mpl-2.0 | spdx mpl | {_ID} mpl 2 0
epl-1.0 | spdx epl | {_ID} epl 1 0
epl-2.0 | spdx epl | {_ID} epl 2 0
cddl-1.0 | spdx cddl | {_ID} cddl 1 0
cddl-1.1 | spdx cddl | {_ID} cddl 1 1
eupl-1.2 | spdx eupl | {_ID} eupl 1 2
cc0-1.0 | spdx cc0 | {_ID} cc0 1 0
cc-by-3.0 | spdx cc by | {_ID} cc by 3 0
cc-by-4.0 | spdx cc by | {_ID} cc by 4 0
cc-by-sa-3.0 | spdx cc sa | {_ID} cc by sa 3 0
cc-by-sa-4.0 | spdx cc sa | {_ID} cc by sa 4 0
cc-by-nc-4.0 | spdx cc nc | {_ID} cc by nc 4 0
cc-by-nd-4.0 | spdx cc nd | {_ID} cc by nd 4 0
cc-by-nc-sa-4.0 | spdx cc nc sa | {_ID} cc by nc sa 4 0
cc-by-nc-nd-4.0 | spdx cc nc nd | {_ID} cc by nc nd 4 0
unlicense | spdx unlicense | {_ID} unlicense
wtfpl | spdx wtfpl | {_ID} wtfpl
zlib | spdx zlib | {_ID} zlib
bsl-1.0 | spdx bsl | {_ID} bsl 1 0
busl-1.1 | spdx busl | {_ID} busl 1 1
artistic-2.0 | spdx artistic | {_ID} artistic 2 0
postgresql | spdx postgresql | {_ID} postgresql
python-2.0 | spdx | {_ID} (?:python|psf) 2 0
ofl-1.1 | spdx ofl | {_ID} ofl 1 1
odbl-1.0 | spdx odbl | {_ID} odbl 1 0
mit | permission hereby granted charge | permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit | software provided warranty merchantability noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability(?: [^ ]+){{0,8}} noninfringement
mit | above copyright notice substantial portions | the above copyright notice and this permission notice(?: [^ ]+){{0,4}} shall be included in all copies or substantial portions of the software
isc | permission use copy fee hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?: provided that the above copyright notice(?: [^ ]+){{0,12}} copies)?
isc | author disclaims warranties regard | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
bsd-2-clause | redistributions source retain copyright | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions binary reproduce copyright | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | neither endorse promote | neither the name(?:s)? of(?: [^ ]+){{1,12}} (?:may|can|shall|must) be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | redistribution binary modification permitted | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | software provided express implied | this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is and any express or implied warranties
apache-2.0 | apache license version january | apache license version 2 0 january 2004
apache-2.0 | unless required applicable law writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | subject conditions contributor perpetual worldwide | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
apache-1.1 | apache software foundation developed | this product includes software developed by the apache software foundation
gpl-1.0 | gnu general public february | gnu general public license version 1 february 1989
gpl-2.0 | gnu general public june | gnu general public license version 2 june 1991
gpl-3.0 | gnu general public june | gnu general public license version 3 29 june 2007
gpl | free software redistribute modify gnu general | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | program distributed hope useful warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | received copy gnu general public | you should have received a copy of the gnu general public license along with this program
gpl | licenses software designed freedom share | the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change(?: it| the works)?
lgpl-2.0 | gnu library general public june | gnu library general public license version 2 june 1991
lgpl-2.1 | gnu lesser general public february | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | gnu lesser general public june | gnu lesser general public license version 3 29 june 2007
lgpl | library free software redistribute | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | library distributed hope useful warranty | this library is distributed in the hope that it will be useful but without any warranty
agpl-3.0 | gnu affero general public november | gnu affero general public license version 3 19 november 2007
agpl | received copy gnu affero | you should have received a copy of the gnu affero general public license
mpl-1.1 | mozilla public license contents | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | source code form subject mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | copy mpl distributed file obtain | if a copy of the mpl was not distributed with this file you can obtain one at
epl-1.0 | eclipse accompanying program public | the accompanying program is provided under the terms of this eclipse public license
cddl-1.0 | contents file subject distribution | the contents of this file are subject to the terms of the common development and distribution license
cc0-1.0 | cc0 universal statement purpose | cc0 1 0 universal(?: [^ ]+){{0,4}} statement of purpose
cc0-1.0 | person associated work deed dedicated public domain | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | exercising licensed rights creative commons attribution | by exercising the licensed rights(?: [^ ]+){{0,40}} creative commons attribution(?: [0-9] [0-9])? international public license
unlicense | free unencumbered software public domain | this is free and unencumbered software released into the public domain
wtfpl | fuck want | do what the fuck you want to(?: public license)?
zlib | software provided express implied authors damages | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | origin software misrepresented claim | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | boost software license august | boost software license version 1 0 august 17th 2003
bsl-1.0 | permission hereby granted organization accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
artistic-1.0 | intent document state conditions package copied | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | artistic everyone permitted copy distribute verbatim | artistic license 2 0(?: [^ ]+){{0,12}} everyone is permitted to copy and distribute verbatim copies
postgresql | permission use copy agreement hereby fee | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-2.0 | python foundation agreement psf licensee | this license agreement is between the python software foundation psf and the individual or organization licensee
ofl-1.1 | font sil february | sil open font license version 1 1 26 february 2007
ofl-1.1 | font software components sold itself | neither the font software nor any of its individual components(?: [^ ]+){{0,8}} may be sold by itself
openssl | openssl project toolkit product includes | this product includes software developed by the openssl project for use in the openssl toolkit
jpeg | software independent jpeg group | this software is based in part on the work of the independent jpeg group
beerware | beer ware license retain notice | the beer ware license(?: [^ ]+){{0,24}} as long as you retain this notice
x11 | name advertising promote | except as contained in this notice the name of(?: [^ ]+){{1,8}} shall not be used in advertising or otherwise to promote the sale
json | software shall good evil | the software shall be used for good not evil
elastic-2.0 | provide software third hosted managed | you may not provide the software to third parties as a hosted or managed service
sspl-1.0 | functionality program modified service | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | licensor grants production use | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
odbl-1.0 | database made available open | this (?:[^ ]+ ){{0,4}}(?:database )?is made available under the open database license
eupl-1.2 | licensed eupl european union public | licensed under the eupl(?: [^ ]+){{0,24}} european union public licen[cs]e
"""

NOTICE = "\n".join(
    f"{label} | {keys} | {_GRANT} {name}(?: licen[sc]e)?"
    for label, keys, name in (
        line.split(" | ")
        for line in r"""apache-1.1 | apache | apache(?: software)?(?: license)? (?:version |v )?1 1
apache-2.0 | apache | apache(?: software)?(?: license)? (?:version |v )?2(?: 0)?
apache | apache | apache(?: software)?
mit | mit | (?:x11 )?mit
mit | expat | expat
x11 | x11 | x11
bsd-2-clause | bsd | (?:2 clause|two clause|simplified|freebsd)(?: style)? bsd
bsd-2-clause | bsd | bsd 2 clause
bsd-3-clause | bsd | (?:3 clause|three clause|new|modified|revised)(?: style)? bsd
bsd-3-clause | bsd | bsd 3 clause
bsd-4-clause | bsd | (?:4 clause|four clause|original)(?: style)? bsd
bsd | bsd | bsd(?: style)?
isc | isc | isc
gpl-2.0-or-later | gpl later | gpl (?:version |v )?2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-or-later | gpl later | gpl (?:version |v )?3(?: 0)? or (?:any )?later(?: version)?
gpl-2.0 | gpl | gpl (?:version |v )?2(?: 0)?(?: only)?
gpl-3.0 | gpl | gpl (?:version |v )?3(?: 0)?(?: only)?
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gplv3 | gplv3
gpl | gpl | (?:gnu )?gpl
gpl-2.0-or-later | general public later | gnu general public license (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-3.0-or-later | general public later | gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-2.0 | general public | (?:gnu )?general public license (?:as published by the free software foundation )?(?:version |v )2(?: 0)?
gpl-3.0 | general public | (?:gnu )?general public license (?:as published by the free software foundation )?(?:version |v )3(?: 0)?
gpl | general public | (?:gnu )?general public
lgpl-2.1 | lgpl | (?:gnu )?lgpl (?:version |v )?2 1(?: or later)?
lgpl-3.0 | lgpl | (?:gnu )?lgpl (?:version |v )?3(?: 0)?(?: or later)?
lgpl | lgpl | (?:gnu )?lgpl
lgpl-2.1 | lesser general public | (?:gnu )?lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-3.0 | lesser general public | (?:gnu )?lesser general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl | lesser general public | (?:gnu )?lesser general public
agpl-3.0 | agpl | (?:gnu )?agpl (?:version |v )?3(?: 0)?(?: or later)?
agpl-3.0 | agplv3 | agplv3
agpl-3.0 | affero general public | (?:gnu )?affero general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?
agpl | affero general public | (?:gnu )?affero general public
mpl-1.1 | mozilla public | mozilla public license (?:version |v )?1 1
mpl-2.0 | mozilla public | mozilla public license (?:version |v )?2 0
mpl | mozilla public | mozilla public
mpl-2.0 | mpl | mpl (?:version |v )?2(?: 0)?
epl-1.0 | eclipse public | eclipse public license (?:version |v )?1 0
epl-2.0 | eclipse public | eclipse public license (?:version |v )?2 0
epl | eclipse public | eclipse public
cddl | cddl | cddl(?: (?:version |v )?1 [01])?
cddl | common development distribution | common development and distribution
eupl | european union public | european union public
bsl-1.0 | boost software | boost software(?: license)?(?: (?:version |v )?1 0)?
zlib | zlib | zlib(?: libpng)?
artistic-2.0 | artistic | (?:perl )?artistic(?: license)? 2 0
artistic-1.0 | artistic | (?:perl )?artistic(?: license)?(?: 1 0)?
postgresql | postgresql | postgresql
python-2.0 | python | python software foundation
python-2.0 | psf | psf(?: python)?
unlicense | unlicense | unlicense
wtfpl | wtfpl | wtfpl
ofl-1.1 | font | (?:sil )?open font(?: license)?(?: (?:version |v )?1 1)?
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by-nc-nd | creative commons noncommercial noderivatives | creative commons attribution noncommercial noderivatives(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-nc-nd | creative commons commercial derivatives | creative commons attribution non commercial no derivatives(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-nc-sa | creative commons noncommercial sharealike | creative commons attribution noncommercial sharealike(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-nc-sa | creative commons commercial alike | creative commons attribution non commercial share alike(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-nc | creative commons noncommercial | creative commons attribution noncommercial(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-nc | creative commons commercial | creative commons attribution non commercial(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-nd | creative commons noderivatives | creative commons attribution noderivatives(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-nd | creative commons derivatives | creative commons attribution no derivatives(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-sa | creative commons sharealike | creative commons attribution sharealike(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-sa | creative commons alike | creative commons attribution share alike(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by | creative commons attribution | creative commons attribution(?: (?:version |v )?[1-4] [0-9])?(?: international| unported)?
cc-by-nc-nd | cc nc nd | (?:creative commons )?cc by nc nd(?: [1-4] [0-9])?
cc-by-nc-sa | cc nc sa | (?:creative commons )?cc by nc sa(?: [1-4] [0-9])?
cc-by-nc | cc nc | (?:creative commons )?cc by nc(?: [1-4] [0-9])?
cc-by-nd | cc nd | (?:creative commons )?cc by nd(?: [1-4] [0-9])?
cc-by-sa | cc sa | (?:creative commons )?cc by sa(?: [1-4] [0-9])?
cc-by | cc by | (?:creative commons )?cc by(?: [1-4] [0-9])?
cc | creative commons | (?:open )?creative commons
odbl-1.0 | open database | open database
pddl-1.0 | dedication | public domain dedication
odc-by-1.0 | open commons attribution | open data commons attribution
elastic-2.0 | elastic | elastic(?: license)?(?: (?:version |v )?2(?: 0)?)?
sspl-1.0 | server side public | server side public
busl-1.1 | business source | business source(?: license)?(?: 1 1)?
ms-pl | microsoft public | microsoft public
ms-rl | microsoft reciprocal | microsoft reciprocal
afl-3.0 | academic free | academic free(?: license)?(?: (?:version |v )?3 0)?
osl-3.0 | open software | open software license(?: (?:version |v )?3 0)?
cpl-1.0 | common public | common public
ibm-pl | ibm public | ibm public
cecill | cecill | cecill(?: [bc])?
openrail | openrail | (?:[a-z]+ )?openrail(?: [a-z])?
llama | llama community | llama(?: [0-9]){0,2} community
gfdl | free documentation | gnu free documentation
uk-ogl | open government | open government""".splitlines()
    )
)

VERSION = r"""
apache-1.1 | apache license | apache(?: software)? license (?:version |v )?1 1
apache-2.0 | apache license | apache(?: software)? license (?:version |v )?2(?: 0)?
apache-2.0 | apache | apache 2 0(?: license)?
apache-2.0 | apache licenses org | (?:www )?apache org licenses license 2 0
bsd-2-clause | bsd clause | bsd 2 clause
bsd-3-clause | bsd clause | bsd 3 clause
bsd-4-clause | bsd clause | bsd 4 clause
bsd-2-clause | bsd license | (?:2 clause|two clause|simplified) bsd license
bsd-3-clause | bsd license | (?:3 clause|three clause|new|modified|revised) bsd license
bsd-4-clause | bsd license | (?:4 clause|four clause|original) bsd license
gpl-2.0-or-later | gpl later | gpl (?:version |v )?2(?: 0)? or (?:any )?later
gpl-3.0-or-later | gpl later | gpl (?:version |v )?3(?: 0)? or (?:any )?later
gpl-1.0 | gpl | gpl (?:version |v )?1(?: 0)?
gpl-2.0 | gpl | gpl (?:version |v )?2(?: 0)?
gpl-3.0 | gpl | gpl (?:version |v )?3(?: 0)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2
gpl-3.0 | gplv3 | (?:gnu )?gplv3
gpl-2.0 | general public license | (?:gnu )?general public license (?:version |v )2(?: 0)?
gpl-3.0 | general public license | (?:gnu )?general public license (?:version |v )3(?: 0)?
lgpl-2.0 | lgpl | lgpl (?:version |v )?2(?: 0)?
lgpl-2.1 | lgpl | lgpl (?:version |v )?2 1
lgpl-3.0 | lgpl | lgpl (?:version |v )?3(?: 0)?
lgpl-2.1 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | lgplv3 | lgplv3
lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:version |v )2 1
lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:version |v )3(?: 0)?
agpl-3.0 | agpl | agpl (?:version |v )?3(?: 0)?
agpl-3.0 | agplv3 | agplv3
agpl-3.0 | affero general public license | (?:gnu )?affero general public license (?:version |v )3(?: 0)?
gpl | gnu licenses | (?:www )?gnu org licenses gpl(?: html| txt)?
gpl-2.0 | gnu licenses gpl | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0 | gnu licenses gpl | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
lgpl | gnu licenses lgpl | (?:www )?gnu org licenses lgpl(?: 3 0)?(?: html| txt)?
agpl-3.0 | gnu licenses agpl | (?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
mpl-1.0 | mozilla public license | mozilla public license (?:version |v )?1 0
mpl-1.1 | mozilla public license | mozilla public license (?:version |v )?1 1
mpl-2.0 | mozilla public license | mozilla public license (?:version |v )?2 0
mpl-2.0 | mpl | mpl (?:version |v )?2 0
mpl-2.0 | mozilla mpl | (?:www )?mozilla org (?:en us )?mpl 2 0
epl-1.0 | eclipse public license | eclipse public license (?:version |v )?1 0
epl-2.0 | eclipse public license | eclipse public license (?:version |v )?2 0
epl-1.0 | epl eclipse | (?:www )?eclipse org legal epl v10(?: html)?
epl-2.0 | epl eclipse | (?:www )?eclipse org legal epl 2 0
cddl-1.0 | cddl | cddl (?:version |v )?1 0
cddl-1.1 | cddl | cddl (?:version |v )?1 1
eupl-1.1 | eupl | eupl (?:version |v )?1 1
eupl-1.2 | eupl | eupl (?:version |v )?1 2
bsl-1.0 | boost | boost software license (?:version |v )?1 0
bsl-1.0 | boost | (?:www )?boost org license 1 0(?: txt)?
artistic-1.0 | artistic license | artistic license (?:version |v )?1 0
artistic-2.0 | artistic license | artistic license (?:version |v )?2 0
mit | opensource mit | opensource org licenses? mit(?: license(?: php)?)?
bsd-2-clause | opensource bsd | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource bsd | opensource org licenses? bsd 3 clause
isc | opensource isc | opensource org licenses? isc
apache-2.0 | opensource apache | opensource org licenses? apache 2 0
cc-by-1.0 | creativecommons licenses by | creativecommons org licenses by 1 0
cc-by-2.0 | creativecommons licenses by | creativecommons org licenses by 2 0
cc-by-2.5 | creativecommons licenses by | creativecommons org licenses by 2 5
cc-by-3.0 | creativecommons licenses by | creativecommons org licenses by 3 0
cc-by-4.0 | creativecommons licenses by | creativecommons org licenses by 4 0
cc-by-sa-2.0 | creativecommons licenses sa | creativecommons org licenses by sa 2 0
cc-by-sa-3.0 | creativecommons licenses sa | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | creativecommons licenses sa | creativecommons org licenses by sa 4 0
cc-by-nc-4.0 | creativecommons licenses nc | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | creativecommons licenses nd | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | creativecommons licenses nc sa | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons licenses nc nd | creativecommons org licenses by nc nd 4 0
cc0-1.0 | creativecommons publicdomain zero | creativecommons org publicdomain zero 1 0
pdm-1.0 | creativecommons publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by-1.0 | cc by | cc by 1 0
cc-by-2.0 | cc by | cc by 2 0
cc-by-2.5 | cc by | cc by 2 5
cc-by-3.0 | cc by | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa-2.0 | cc by sa | cc by sa 2 0
cc-by-sa-3.0 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | cc by sa | cc by sa 4 0
cc-by-nc-3.0 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | cc by nc | cc by nc 4 0
cc-by-nd-4.0 | cc by nd | cc by nd 4 0
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
cc0-1.0 | cc0 | cc0 1 0(?: universal)?
cc-by-4.0 | creative commons attribution international | creative commons attribution 4 0 international(?: public)?(?: license)?
cc-by-3.0 | creative commons attribution unported | creative commons attribution 3 0 unported(?: license)?
cc-by-sa-4.0 | creative commons attribution sharealike international | creative commons attribution sharealike 4 0 international(?: public)?(?: license)?
cc-by-sa-3.0 | creative commons attribution sharealike unported | creative commons attribution sharealike 3 0 unported(?: license)?
ofl-1.1 | open font license | (?:sil )?open font license (?:version |v )?1 1
odbl-1.0 | open database license | open database license (?:odbl )?(?:version |v )?1 0
elastic-2.0 | elastic license | elastic license (?:version |v )?2(?: 0)?
busl-1.1 | business source license | business source license (?:version |v )?1 1
gfdl-1.2 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 2
gfdl-1.3 | free documentation license | (?:gnu )?free documentation license (?:version |v )?1 3
unlicense | unlicense org | (?:www )?unlicense org
wtfpl | wtfpl net | (?:www )?wtfpl net
"""

NAME = r"""
mit | mit license | (?:the )?mit(?: x11)? license
mit | expat license | expat license
mit-0 | mit attribution | mit no attribution
x11 | x11 license | x11 license
apache | apache license | apache(?: software)? license
bsd | bsd license | bsd(?: style)? license
isc | isc license | isc license
gpl | gnu gpl | gnu gpl
gpl | gnu general public license | gnu general public license
lgpl | gnu lgpl | gnu lgpl
lgpl | lesser general public license | (?:gnu )?lesser general public license
lgpl | library general public license | (?:gnu )?library general public license
agpl | gnu agpl | gnu agpl
agpl | affero general public license | (?:gnu )?affero general public license
mpl | mozilla public license | mozilla public license
epl | eclipse public license | eclipse public license
cddl | common development distribution license | common development and distribution license
cpl-1.0 | common public license | common public license
eupl | european union public | european union public licen[cs]e
bsl-1.0 | boost software license | boost software license
zlib | zlib license | zlib(?: libpng)? license
artistic-1.0 | artistic license | artistic license
postgresql | postgresql license | postgresql license
python-2.0 | python license | python(?: software foundation)? license
php | php license | php license
ruby | ruby license | ruby license
openssl | openssl license | openssl license
curl | curl license | curl license
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
beerware | beerware | beerware(?: license)?
ofl-1.1 | open font license | (?:sil )?open font license
cc0-1.0 | creative commons zero | creative commons zero
cc0-1.0 | cc0 | cc0
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc | cc by nc | cc by nc
cc-by-nd | cc by nd | cc by nd
cc-by-sa | cc by sa | cc by sa
cc-by-sa | creative commons attribution | creative commons attribution share ?alike
cc-by-nc | creative commons attribution | creative commons attribution non ?commercial
cc-by-nd | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s
cc-by | creative commons attribution | creative commons attribution
odbl-1.0 | open database license | open database license
odc-by-1.0 | open data commons attribution license | open data commons attribution license
pddl-1.0 | open data commons public domain | open data commons public domain dedication(?: and license)?
elastic-2.0 | elastic license | elastic license
sspl-1.0 | server side public license | server side public license
busl-1.1 | business source license | business source license
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
afl-3.0 | academic free license | academic free license
osl-3.0 | open software license | open software license
cecill | cecill license | cecill(?: [bc])? license
openrail | openrail | (?:creativeml |bigscience )?openrail(?: [m])?(?: license)?
llama | llama community license | llama(?: [0-9]){0,2} community license
gfdl | free documentation license | (?:gnu )?free documentation license
uk-ogl | open government licence | open government licence
eula | end user license agreement | end user license agreement
commons-clause | commons clause | commons clause
polyform-nc | polyform noncommercial | polyform noncommercial(?: license)?
"""

HINT = r"""
public-domain | public domain | (?:released|placed|dedicated|donated) (?:in|to|into) the public domain
public-domain | public domain | (?:this work|this file|the text|the author has) (?:is|are|placed|released|dedicated)(?: [^ ]+){0,3} (?:in|into|to) the public domain
cc | creative commons license | (?:a |the )?creative commons license
cc | commons rights | some rights reserved(?: [^ ]+){0,4} creative commons
copyright | copyright | copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | © | © (?:19|20)[0-9]{2}
proprietary | confidential proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized prohibited | unauthorized (?:copying|reproduction|use)(?: [^ ]+){0,8} prohibited
proprietary | permission written | may not be (?:reproduced|copied|distributed)(?: [^ ]+){0,10} without (?:the )?(?:prior )?(?:express )?written permission
proprietary | trade secrets | contains trade secrets
noncommercial | commercial use only | for non commercial use only
noncommercial | noncommercial use only | for noncommercial use only
noncommercial | personal use only | for (?:your )?personal(?: non commercial| noncommercial)? use only
research-only | purposes only | for (?:academic |non commercial )?(?:research|academic) purposes only
free | permission copy distribute granted | permission is granted to copy(?: and or| and)? distribute(?: [^ ]+){0,4}
see-file | license file | see (?:the )?(?:accompanying |included )?license(?: txt| md)? file
see-file | license details | see (?:the )?(?:file )?license(?: txt| md)? for (?:more )?details
dual | dual licensed | dual licensed(?: under)?
"""


def parsed() -> list[tuple[str, str, tuple[str, ...], str]]:
    """class, label, keywords, regex of all rules, in order."""
    out = []
    for kind, block in zip(CLASSES, (TEXT, NOTICE, VERSION, NAME, HINT)):
        for line in block.strip().splitlines():
            label, keys, regex = line.split(" | ", 2)
            out.append((kind, label, tuple(keys.split()), regex))
    return out
