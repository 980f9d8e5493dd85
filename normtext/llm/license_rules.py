"""The signature rules of the licence scan, as data.

A rule is ``label ; weight ; keywords ; pattern``, in its priority's list; the order inside a list is the order of the
rules. Patterns are over words: a space stands between two words, and a pattern matches whole words only. Groups,
alternatives, ``?`` and character classes of the words' own characters are used, nothing else. All
keywords of a rule must be among a text's words before its pattern is tried, so each must be part of every match.
"""

from __future__ import annotations

from typing import NamedTuple

BASE_PHRASES = (("cc-by", 0.8, "cc by"), ("gpl", 0.9, "general public license"), ("reserved", 0.7, "all rights reserved"))

# Sentences that grant a licence or name it by a full identifier.
GRANTS = """
apache-2.0 ; 0.99 ; apache ; licensed under the apache licen[sc]e(?: version)? 2(?: 0)?
apache-2.0 ; 0.99 ; apache ; released under the apache licen[sc]e(?: version)? 2(?: 0)?
apache-2.0 ; 0.99 ; apache licenses ; (?:www )?apache org licenses license 2 0
apache-2.0 ; 0.99 ; apache spdx ; spdx license identifier apache 2 0
apache-1.1 ; 0.99 ; apache ; licensed under the apache (?:software )?licen[sc]e(?: version)? 1 1
mit ; 0.99 ; mit ; (?:licensed|released|distributed|available|published) under the (?:terms of the )?mit licen[sc]e
mit ; 0.99 ; hereby granted charge obtaining ; permission is hereby granted free of charge to any person obtaining a copy
mit ; 0.99 ; mit spdx ; spdx license identifier mit
mit ; 0.98 ; mit opensource ; opensource org licenses mit(?: license)?
mit-0 ; 0.99 ; mit spdx ; spdx license identifier mit 0
isc ; 0.99 ; isc ; (?:licensed|released) under the isc licen[sc]e
isc ; 0.98 ; permission modify distribute purpose fee ; permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
isc ; 0.99 ; isc spdx ; spdx license identifier isc
gpl-3.0 ; 0.99 ; gnu ; (?:licensed|released|distributed) under the (?:terms of the )?gnu general public licen[sc]e version 3(?: 0)?
gpl-3.0 ; 0.99 ; gnu ; gnu general public licen[sc]e version 3 or (?:at your option )?(?:any )?later
gpl-2.0 ; 0.99 ; gnu ; (?:licensed|released|distributed) under the (?:terms of the )?gnu general public licen[sc]e version 2(?: 0)?
gpl-2.0 ; 0.99 ; gnu ; gnu general public licen[sc]e version 2 or (?:at your option )?(?:any )?later
gpl-3.0 ; 0.98 ; redistribute gnu ; you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3
gpl-2.0 ; 0.98 ; redistribute gnu ; you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2
gpl-3.0 ; 0.99 ; gpl spdx ; spdx license identifier gpl 3 0(?: only| or later)?
gpl-2.0 ; 0.99 ; gpl spdx ; spdx license identifier gpl 2 0(?: only| or later)?
gpl-1.0 ; 0.99 ; gpl spdx ; spdx license identifier gpl 1 0(?: only| or later)?
gpl ; 0.97 ; gnu licenses ; (?:www )?gnu org licenses(?: gpl(?: html| txt)?)?
lgpl-3.0 ; 0.99 ; gnu lesser ; (?:licensed|released|distributed) under the (?:terms of the )?gnu lesser general public licen[sc]e version 3(?: 0)?
lgpl-2.1 ; 0.99 ; gnu lesser ; (?:licensed|released|distributed) under the (?:terms of the )?gnu lesser general public licen[sc]e version 2 1
lgpl-2.0 ; 0.99 ; gnu library ; under the terms of the gnu library general public licen[sc]e version 2(?: 0)?
lgpl-3.0 ; 0.99 ; lgpl spdx ; spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 ; 0.99 ; lgpl spdx ; spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.0 ; 0.99 ; lgpl spdx ; spdx license identifier lgpl 2 0(?: only| or later)?
agpl-3.0 ; 0.99 ; gnu affero ; (?:licensed|released|distributed) under the (?:terms of the )?gnu affero general public licen[sc]e(?: version 3(?: 0)?)?
agpl-3.0 ; 0.99 ; agpl spdx ; spdx license identifier agpl 3 0(?: only| or later)?
bsd-3-clause ; 0.99 ; bsd spdx ; spdx license identifier bsd 3 clause
bsd-2-clause ; 0.99 ; bsd spdx ; spdx license identifier bsd 2 clause
0bsd ; 0.99 ; 0bsd spdx ; spdx license identifier 0bsd
bsd-3-clause ; 0.98 ; neither endorse ; neither the name of (?:the )?[a-z0-9]+(?: [a-z0-9]+)? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause ; 0.98 ; advertising acknowledgement ; all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd ; 0.97 ; redistribution binary ; redistribution and use in source and binary forms with or without modification are permitted
bsd ; 0.98 ; bsd ; (?:licensed|released|distributed|available) under (?:the|a) bsd(?: style)? licen[sc]e
mpl-2.0 ; 0.99 ; mozilla ; subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0
mpl-2.0 ; 0.99 ; mozilla ; (?:licensed|released) under the mozilla public licen[sc]e(?: version)? 2(?: 0)?
mpl-2.0 ; 0.99 ; mozilla mpl ; mozilla org mpl 2 0
mpl-2.0 ; 0.99 ; mpl spdx ; spdx license identifier mpl 2 0
mpl-1.1 ; 0.99 ; mozilla ; subject to the mozilla public licen[sc]e version 1 1
mpl-1.1 ; 0.99 ; mpl spdx ; spdx license identifier mpl 1 1
epl-2.0 ; 0.99 ; eclipse ; (?:available|licensed) under the terms of the eclipse public licen[sc]e(?: v)? 2 0
epl-1.0 ; 0.99 ; eclipse ; (?:available|licensed) under the terms of the eclipse public licen[sc]e(?: v)? 1 0
epl-2.0 ; 0.99 ; epl spdx ; spdx license identifier epl 2 0
epl-1.0 ; 0.99 ; epl spdx ; spdx license identifier epl 1 0
cddl-1.0 ; 0.99 ; cddl spdx ; spdx license identifier cddl 1 0
cddl-1.1 ; 0.99 ; cddl spdx ; spdx license identifier cddl 1 1
bsl-1.0 ; 0.99 ; boost ; distributed under the boost software licen[sc]e(?: version)? 1 0
bsl-1.0 ; 0.99 ; bsl spdx ; spdx license identifier bsl 1 0
zlib ; 0.98 ; implied warranty damages ; provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib ; 0.99 ; zlib spdx ; spdx license identifier zlib
unlicense ; 0.99 ; unencumbered domain ; this is free and unencumbered software released into the public domain
unlicense ; 0.99 ; unlicense spdx ; spdx license identifier unlicense
unlicense ; 0.98 ; unlicense org ; unlicense org
wtfpl ; 0.99 ; fuck ; do what the fuck you want to(?: public licen[sc]e)?
wtfpl ; 0.99 ; wtfpl spdx ; spdx license identifier wtfpl
artistic-2.0 ; 0.99 ; artistic spdx ; spdx license identifier artistic 2 0
artistic-1.0 ; 0.98 ; same terms perl ; under the same terms as perl itself
artistic-1.0 ; 0.98 ; artistic perl ; perl artistic licen[sc]e
cc-by-4.0 ; 0.99 ; cc ; licensed under (?:a |the )?cc by(?: licen[sc]e)?(?: v)? 4 0
cc-by-3.0 ; 0.99 ; cc ; licensed under (?:a |the )?cc by(?: licen[sc]e)?(?: v)? 3 0
cc-by-2.0 ; 0.99 ; cc ; licensed under (?:a |the )?cc by(?: licen[sc]e)?(?: v)? 2 0
cc-by-sa-4.0 ; 0.99 ; cc sa ; licensed under (?:a |the )?cc by sa 4 0
cc-by-sa-3.0 ; 0.99 ; cc sa ; licensed under (?:a |the )?cc by sa 3 0
cc-by-nc-4.0 ; 0.99 ; cc nc ; licensed under (?:a |the )?cc by nc 4 0
cc-by-nc-3.0 ; 0.99 ; cc nc ; licensed under (?:a |the )?cc by nc 3 0
cc-by-nd-4.0 ; 0.99 ; cc nd ; licensed under (?:a |the )?cc by nd 4 0
cc-by-nc-sa-4.0 ; 0.99 ; cc nc sa ; licensed under (?:a |the )?cc by nc sa 4 0
cc-by-nc-sa-3.0 ; 0.99 ; cc nc sa ; licensed under (?:a |the )?cc by nc sa 3 0
cc-by-nc-nd-4.0 ; 0.99 ; cc nc nd ; licensed under (?:a |the )?cc by nc nd 4 0
cc-by-nc-nd-3.0 ; 0.99 ; cc nc nd ; licensed under (?:a |the )?cc by nc nd 3 0
cc-by-4.0 ; 0.99 ; creativecommons ; creativecommons org licenses by 4 0
cc-by-3.0 ; 0.99 ; creativecommons ; creativecommons org licenses by 3 0
cc-by-2.0 ; 0.99 ; creativecommons ; creativecommons org licenses by 2 0
cc-by-sa-4.0 ; 0.99 ; creativecommons ; creativecommons org licenses by sa 4 0
cc-by-sa-3.0 ; 0.99 ; creativecommons ; creativecommons org licenses by sa 3 0
cc-by-nc-4.0 ; 0.99 ; creativecommons ; creativecommons org licenses by nc 4 0
cc-by-nd-4.0 ; 0.99 ; creativecommons ; creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 ; 0.99 ; creativecommons ; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 ; 0.99 ; creativecommons ; creativecommons org licenses by nc nd 4 0
cc0-1.0 ; 0.99 ; creativecommons publicdomain ; creativecommons org publicdomain zero 1 0
cc0-1.0 ; 0.99 ; cc0 spdx ; spdx license identifier cc0 1 0
cc-by-4.0 ; 0.99 ; creative commons attribution ; creative commons attribution 4 0 international(?: public)? licen[sc]e
cc-by-sa-4.0 ; 0.99 ; creative commons sharealike ; creative commons attribution sharealike 4 0 international(?: public)? licen[sc]e
cc-by-sa-3.0 ; 0.99 ; creative commons sharealike ; creative commons attribution sharealike 3 0 unported(?: licen[sc]e)?
cc-by-nc-4.0 ; 0.99 ; creative commons noncommercial ; creative commons attribution noncommercial 4 0 international(?: public)? licen[sc]e
cc-by-nc-sa-4.0 ; 0.99 ; creative commons noncommercial ; creative commons attribution noncommercial sharealike 4 0 international(?: public)? licen[sc]e
cc-by-nc-nd-4.0 ; 0.99 ; creative commons noncommercial ; creative commons attribution noncommercial noderiv(?:ative)?s 4 0 international(?: public)? licen[sc]e
cc-by-nd-4.0 ; 0.99 ; creative commons ; creative commons attribution noderiv(?:ative)?s 4 0 international(?: public)? licen[sc]e
ofl-1.1 ; 0.99 ; sil font ; licensed under the sil open font licen[sc]e(?: version)? 1 1
ofl-1.1 ; 0.99 ; ofl spdx ; spdx license identifier ofl 1 1
gfdl ; 0.99 ; gnu documentation ; under the terms of the gnu free documentation licen[sc]e(?: version 1 [123])?
eupl-1.2 ; 0.99 ; eupl ; licensed under the eupl(?: version)?(?: v)? 1 2
eupl-1.1 ; 0.99 ; eupl ; licensed under the eupl(?: version)?(?: v)? 1 1
odbl-1.0 ; 0.99 ; odbl ; (?:licensed|available) under the (?:open database licen[sc]e )?odbl(?: v)?(?: 1 0)?
ogl-3.0 ; 0.99 ; government licence ; licensed under the open government licence(?: v| version)? 3 0
elastic-2.0 ; 0.99 ; elastic ; licensed under the elastic licen[sc]e(?: version)? 2(?: 0)?
sspl-1.0 ; 0.99 ; sspl spdx ; spdx license identifier sspl 1 0
busl-1.1 ; 0.99 ; busl spdx ; spdx license identifier busl 1 1
"""

# Names with a version.
VERSIONED = """
apache-2.0 ; 0.95 ; apache ; apache (?:software )?licen[sc]e(?: version)? 2(?: 0)?
apache-2.0 ; 0.95 ; apache ; apache 2(?: 0)? licen[sc]e
apache-1.1 ; 0.95 ; apache ; apache (?:software )?licen[sc]e(?: version)? 1 1
apache-1.0 ; 0.95 ; apache ; apache (?:software )?licen[sc]e(?: version)? 1 0
gpl-3.0 ; 0.96 ; gnu ; gnu general public licen[sc]e(?: version)?(?: v)? 3(?: 0)?
gpl-2.0 ; 0.96 ; gnu ; gnu general public licen[sc]e(?: version)?(?: v)? 2(?: 0)?
gpl-1.0 ; 0.96 ; gnu ; gnu general public licen[sc]e(?: version)?(?: v)? 1(?: 0)?
gpl-3.0 ; 0.9 ; gplv3 ; (?:gnu )?gplv3
gpl-2.0 ; 0.9 ; gplv2 ; (?:gnu )?gplv2
gpl-3.0 ; 0.9 ; gpl ; (?:gnu )?gpl(?: version| v)? 3(?: 0)?
gpl-2.0 ; 0.9 ; gpl ; (?:gnu )?gpl(?: version| v)? 2(?: 0)?
lgpl-3.0 ; 0.95 ; lesser ; (?:gnu )?lesser general public licen[sc]e(?: version| v)? 3(?: 0)?
lgpl-2.1 ; 0.95 ; lesser ; (?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1
lgpl-3.0 ; 0.9 ; lgpl ; (?:gnu )?lgpl(?: version| v)? 3(?: 0)?
lgpl-2.1 ; 0.9 ; lgpl ; (?:gnu )?lgpl(?: version| v)? 2 1
lgpl-3.0 ; 0.9 ; lgplv3 ; lgplv3
lgpl-2.1 ; 0.9 ; lgplv2 ; lgplv2 1
agpl-3.0 ; 0.95 ; affero ; (?:gnu )?affero general public licen[sc]e(?: version| v)? 3(?: 0)?
agpl-3.0 ; 0.9 ; agpl ; (?:gnu )?agpl(?: version| v)? 3(?: 0)?
agpl-3.0 ; 0.9 ; agplv3 ; agplv3
mpl-2.0 ; 0.95 ; mozilla ; mozilla public licen[sc]e(?: version| v)? 2(?: 0)?
mpl-1.1 ; 0.95 ; mozilla ; mozilla public licen[sc]e(?: version| v)? 1 1
mpl-1.0 ; 0.95 ; mozilla ; mozilla public licen[sc]e(?: version| v)? 1 0
mpl-2.0 ; 0.9 ; mpl ; mpl(?: version| v)? 2(?: 0)?
epl-2.0 ; 0.95 ; eclipse ; eclipse public licen[sc]e(?: version| v)? 2 0
epl-1.0 ; 0.95 ; eclipse ; eclipse public licen[sc]e(?: version| v)? 1 0
cddl-1.0 ; 0.95 ; distribution ; common development and distribution licen[sc]e(?: version| v)? 1 0
cddl-1.1 ; 0.95 ; distribution ; common development and distribution licen[sc]e(?: version| v)? 1 1
cddl-1.0 ; 0.9 ; cddl ; cddl(?: version| v)? 1 0
cpl-1.0 ; 0.95 ; common ; common public licen[sc]e(?: version| v)? 1 0
ibm-pl-1.0 ; 0.95 ; ibm ; ibm public licen[sc]e(?: version| v)? 1 0
bsl-1.0 ; 0.95 ; boost ; boost software licen[sc]e(?: version| v)? 1 0
artistic-2.0 ; 0.95 ; artistic ; artistic licen[sc]e(?: version| v)? 2 0
artistic-1.0 ; 0.95 ; artistic ; artistic licen[sc]e(?: version| v)? 1 0
bsd-2-clause ; 0.95 ; bsd clause ; (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?
bsd-3-clause ; 0.95 ; bsd clause ; (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?
bsd-4-clause ; 0.95 ; bsd clause ; (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?
bsd-2-clause ; 0.95 ; bsd ; simplified bsd(?: licen[sc]e)?
bsd-3-clause ; 0.95 ; bsd ; (?:new|revised|modified) bsd(?: licen[sc]e)?
bsd-4-clause ; 0.95 ; bsd ; (?:original|old) bsd(?: licen[sc]e)?
cc-by-4.0 ; 0.93 ; cc ; cc by(?: v)? 4 0
cc-by-3.0 ; 0.93 ; cc ; cc by(?: v)? 3 0
cc-by-2.5 ; 0.93 ; cc ; cc by(?: v)? 2 5
cc-by-2.0 ; 0.93 ; cc ; cc by(?: v)? 2 0
cc-by-1.0 ; 0.93 ; cc ; cc by(?: v)? 1 0
cc-by-sa-4.0 ; 0.93 ; cc sa ; cc by sa(?: v)? 4 0
cc-by-sa-3.0 ; 0.93 ; cc sa ; cc by sa(?: v)? 3 0
cc-by-sa-2.5 ; 0.93 ; cc sa ; cc by sa(?: v)? 2 5
cc-by-sa-2.0 ; 0.93 ; cc sa ; cc by sa(?: v)? 2 0
cc-by-nc-4.0 ; 0.93 ; cc nc ; cc by nc(?: v)? 4 0
cc-by-nc-3.0 ; 0.93 ; cc nc ; cc by nc(?: v)? 3 0
cc-by-nc-2.0 ; 0.93 ; cc nc ; cc by nc(?: v)? 2 0
cc-by-nd-4.0 ; 0.93 ; cc nd ; cc by nd(?: v)? 4 0
cc-by-nd-3.0 ; 0.93 ; cc nd ; cc by nd(?: v)? 3 0
cc-by-nc-sa-4.0 ; 0.93 ; cc nc sa ; cc by nc sa(?: v)? 4 0
cc-by-nc-sa-3.0 ; 0.93 ; cc nc sa ; cc by nc sa(?: v)? 3 0
cc-by-nc-nd-4.0 ; 0.93 ; cc nc nd ; cc by nc nd(?: v)? 4 0
cc-by-nc-nd-3.0 ; 0.93 ; cc nc nd ; cc by nc nd(?: v)? 3 0
cc0-1.0 ; 0.93 ; cc0 ; cc0(?: v)? 1 0(?: universal)?
ofl-1.1 ; 0.95 ; font ; (?:sil )?open font licen[sc]e(?: version| v)? 1 1
ofl-1.0 ; 0.95 ; font ; (?:sil )?open font licen[sc]e(?: version| v)? 1 0
gfdl-1.3 ; 0.95 ; documentation ; (?:gnu )?free documentation licen[sc]e(?: version| v)? 1 3
gfdl-1.2 ; 0.95 ; documentation ; (?:gnu )?free documentation licen[sc]e(?: version| v)? 1 2
eupl-1.2 ; 0.95 ; european ; european union public licen[sc]e(?: version| v)? 1 2
eupl-1.1 ; 0.95 ; european ; european union public licen[sc]e(?: version| v)? 1 1
cecill-2.1 ; 0.93 ; cecill ; cecill(?: version| v)? 2 1
cecill-2.0 ; 0.93 ; cecill ; cecill(?: version| v)? 2 0
lppl-1.3c ; 0.95 ; latex ; latex project public licen[sc]e(?: version| v)? 1 3c?
ogl-3.0 ; 0.95 ; government ; open government licence(?: version| v)? 3 0
ogl-2.0 ; 0.95 ; government ; open government licence(?: version| v)? 2 0
php-3.01 ; 0.95 ; php ; php licen[sc]e(?: version| v)? 3 01
zpl-2.1 ; 0.95 ; zope ; zope public licen[sc]e(?: version| v)? 2 1
afl-3.0 ; 0.95 ; academic ; academic free licen[sc]e(?: version| v)? 3 0
osl-3.0 ; 0.95 ; open software ; open software licen[sc]e(?: version| v)? 3 0
"""

# Names alone.
NAMES = """
apache ; 0.85 ; apache ; apache (?:software )?licen[sc]e
mit ; 0.9 ; mit license ; (?:the )?mit license
mit ; 0.9 ; mit licence ; (?:the )?mit licence
mit ; 0.88 ; expat ; expat licen[sc]e
x11 ; 0.88 ; x11 ; x11 licen[sc]e
gpl ; 0.9 ; gnu ; gnu general public licen[sc]e
gpl ; 0.75 ; gnu gpl ; gnu gpl
lgpl ; 0.9 ; gnu lesser ; gnu lesser general public licen[sc]e
lgpl ; 0.85 ; lesser ; lesser general public licen[sc]e
lgpl ; 0.85 ; library ; library general public licen[sc]e
lgpl ; 0.75 ; gnu lgpl ; gnu lgpl
agpl ; 0.9 ; affero ; (?:gnu )?affero general public licen[sc]e
agpl ; 0.75 ; gnu agpl ; gnu agpl
bsd ; 0.88 ; bsd license ; bsd(?: style)? license
bsd ; 0.88 ; bsd licence ; bsd(?: style)? licence
isc ; 0.88 ; isc ; isc licen[sc]e
mpl ; 0.88 ; mozilla ; mozilla public licen[sc]e
epl ; 0.88 ; eclipse ; eclipse public licen[sc]e
cddl ; 0.88 ; distribution ; common development and distribution licen[sc]e
bsl ; 0.88 ; boost ; boost software licen[sc]e
zlib ; 0.88 ; zlib ; zlib licen[sc]e
zlib ; 0.85 ; libpng ; (?:zlib )?libpng licen[sc]e
artistic ; 0.85 ; artistic ; artistic licen[sc]e
psf ; 0.88 ; python ; python software foundation licen[sc]e
ruby ; 0.8 ; ruby ; ruby licen[sc]e
php ; 0.85 ; php ; php licen[sc]e
openssl ; 0.85 ; openssl ; openssl licen[sc]e
ncsa ; 0.88 ; illinois ; university of illinois ncsa open source licen[sc]e
ncsa ; 0.85 ; ncsa ; ncsa(?: open source)? licen[sc]e
ms-pl ; 0.88 ; microsoft ; microsoft public licen[sc]e
ms-rl ; 0.88 ; microsoft ; microsoft reciprocal licen[sc]e
postgresql ; 0.88 ; postgresql ; postgresql licen[sc]e
unlicense ; 0.85 ; unlicense ; (?:the )?unlicense
wtfpl ; 0.88 ; wtfpl ; wtfpl
ofl ; 0.88 ; font ; (?:sil )?open font licen[sc]e
gfdl ; 0.88 ; documentation ; (?:gnu )?free documentation licen[sc]e
eupl ; 0.88 ; european ; european union public licen[sc]e
cecill ; 0.85 ; cecill ; cecill licen[sc]e|licence cecill
lppl ; 0.88 ; latex ; latex project public licen[sc]e
odbl ; 0.88 ; database ; open database licen[sc]e
odc-by ; 0.88 ; commons ; open data commons attribution licen[sc]e
pddl ; 0.88 ; dedication ; public domain dedication and licen[sc]e
ogl ; 0.88 ; government ; open government licen[sc]e
elastic ; 0.85 ; elastic ; elastic licen[sc]e
sspl ; 0.88 ; server ; server side public licen[sc]e
busl ; 0.88 ; business ; business source licen[sc]e
commons-clause ; 0.85 ; commons clause ; commons clause
cc-by-sa ; 0.85 ; cc sa ; cc by sa
cc-by-nc ; 0.85 ; cc nc ; cc by nc
cc-by-nd ; 0.85 ; cc nd ; cc by nd
cc-by-nc-sa ; 0.87 ; cc nc sa ; cc by nc sa
cc-by-nc-nd ; 0.87 ; cc nc nd ; cc by nc nd
cc0 ; 0.85 ; cc0 ; cc0
cc-by ; 0.87 ; creative commons attribution ; creative commons attribution
cc-by-sa ; 0.88 ; creative commons ; creative commons attribution share ?alike
cc-by-nc ; 0.88 ; creative commons ; creative commons attribution non ?commercial
cc-by-nc-sa ; 0.89 ; creative commons ; creative commons attribution non ?commercial share ?alike
cc-by-nc-nd ; 0.89 ; creative commons ; creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nd ; 0.88 ; creative commons ; creative commons attribution no ?deriv(?:ative)?s
cc0 ; 0.88 ; creative commons zero ; creative commons zero
"""

# Words that speak of a licence or of rights without naming one.
HINTS = """
creative-commons ; 0.7 ; creative commons ; creative commons
creative-commons ; 0.75 ; creative commons ; (?:under a|a) creative commons licen[sc]e
public-domain ; 0.7 ; domain public ; (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain ; 0.65 ; domain public ; is in the public domain
copyright ; 0.6 ; copyright ; copyright(?: c)? (?:19|20)[0-9][0-9]
copyright ; 0.6 ; copyright ; (?:19|20)[0-9][0-9] copyright
copyright ; 0.6 ; © ; ©(?: copyright)? (?:19|20)[0-9][0-9]
copyright ; 0.55 ; copyright ; copyright holders?
proprietary ; 0.7 ; proprietary confidential ; proprietary and confidential|confidential and proprietary
proprietary ; 0.65 ; reproduction prohibited ; (?:unauthorized )?reproduction (?:is )?(?:strictly )?prohibited
proprietary ; 0.65 ; copying prohibited ; (?:unauthorized )?copying (?:of this [a-z0-9]+ )?(?:is )?(?:strictly )?prohibited
proprietary ; 0.65 ; reproduced permission written ; may not be reproduced without (?:the )?(?:prior )?written permission
reserved ; 0.7 ; rights reserved ; (?:no|some) rights reserved
reserved ; 0.7 ; droits réservés ; tous droits réservés
reserved ; 0.7 ; rechte vorbehalten ; alle rechte vorbehalten
reserved ; 0.7 ; derechos reservados ; todos los derechos reservados
reserved ; 0.7 ; diritti riservati ; tutti i diritti riservati
reserved ; 0.7 ; direitos reservados ; todos os direitos reservados
open-licence ; 0.5 ; licensed ; licensed under the terms of
open-licence ; 0.5 ; open source license ; open source license
open-licence ; 0.5 ; open source licence ; open source licence
open-licence ; 0.5 ; licence sous ; sous licence (?:libre|ouverte|creative commons)
open-licence ; 0.5 ; lizenz unter ; unter (?:der|einer) (?:freien )?lizenz
open-licence ; 0.5 ; licencia bajo ; bajo (?:una |la )?licencia
no-warranty ; 0.4 ; warranty kind ; without warranty of any kind
no-warranty ; 0.4 ; warranties conditions kind ; without warranties or conditions of any kind
fair-use ; 0.4 ; fair ; fair use notice
all-media ; 0.4 ; redistributed broadcast ; may not be published broadcast rewritten or redistributed
"""


class Rule(NamedTuple):
    priority: int  # 1 is the strongest
    label: str
    weight: float
    keywords: tuple[str, ...]
    pattern: str


def _read(priority: int, lines: str) -> list[Rule]:
    rows = [line.split(" ; ") for line in lines.strip().splitlines()]
    return [Rule(priority, label, float(weight), tuple(words.split()), pattern) for label, weight, words, pattern in rows]


RULES: tuple[Rule, ...] = tuple(
    rule for priority, lines in enumerate((GRANTS, VERSIONED, NAMES, HINTS), 1) for rule in _read(priority, lines)
)
