"""Signature rules for licenses, in order of precedence.

A signature is a regular expression over the normalised text: words of letters and digits, lower case, one
blank between them; LIC and V stand for spellings that many share. Each rule names the words without which its
expression cannot match. Where one detection contains another, a rule of an earlier or the same kind that contains
beats the one contained; among rules of one kind that find the same place the order of this file decides.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    kind: int
    need: tuple[str, ...]
    pattern: str


#: Kinds in order of precedence, with what a detection of the kind is worth as evidence.
KINDS = ("tag", "notice", "name", "link", "mention")
WORTH = (1.0, 0.95, 0.9, 0.8, 0.5)
TAG, NOTICE, NAME, LINK, MENTION = range(len(KINDS))

#: The phrases that always count.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

_LIC = "licen[cs]es?"
_V = "(?:version |v )?"

# label | words it needs | identifier as words | name | address
_LICENSES = """
apache-1.0 | apache | apache 1 0 | apache (?:software )?LIC V1 0 | apache org licenses license 1 0
apache-1.1 | apache | apache 1 1 | apache (?:software )?LIC V1 1 | apache org licenses license 1 1
apache-2.0 | apache | apache 2 0 | apache (?:software )?LIC (?:version 2|v2|2)(?: 0)? | apache org licenses license 2 0
mit | mit | mit | mit LIC | opensource org licenses mit(?: license)?
mit-0 | mit | mit 0 | mit no attribution(?: LIC)? | opensource org licenses mit 0
x11 | x11 | x11 | x11 LIC | spdx org licenses x11
isc | isc | isc | isc LIC | opensource org licenses isc(?: license)?
bsd-1-clause | bsd | bsd 1 clause | (?:1|one) clause bsd LIC | opensource org licenses bsd 1 clause
bsd-2-clause | bsd | bsd 2 clause | (?:2|two) clause bsd LIC|(?:simplified|freebsd) bsd LIC | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | bsd 3 clause | (?:3|three) clause bsd LIC|(?:modified|new|revised) bsd LIC | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | bsd 4 clause | (?:4|four) clause bsd LIC|(?:original|old) bsd LIC | directory fsf org wiki license bsd 4clause
0bsd | 0bsd | 0bsd | 0bsd LIC | opensource org licenses 0bsd
gpl-1.0 | general public | gpl 1 0(?: only)? | gnu general public LIC V1(?: 0)? | gnu org licenses (?:old licenses )?gpl 1 0
gpl-2.0 | general public | gpl 2 0(?: only)? | gnu general public LIC (?:version 2|v2|2)(?: 0)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | general public | gpl 3 0(?: only)? | gnu general public LIC (?:version 3|v3|3)(?: 0)? | gnu org licenses gpl 3 0
lgpl-2.0 | lgpl | lgpl 2 0(?: only)? | gnu (?:library|lesser) general public LIC (?:version 2|v2|2)(?: 0)? | gnu org licenses (?:old licenses )?lgpl 2 0
lgpl-2.1 | lgpl | lgpl 2 1(?: only)? | gnu lesser general public LIC (?:version |v )?2 1 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | lgpl | lgpl 3 0(?: only)? | gnu lesser general public LIC (?:version 3|v3|3)(?: 0)? | gnu org licenses lgpl 3 0
agpl-3.0 | agpl | agpl 3 0(?: only)? | gnu affero general public LIC (?:version 3|v3|3)(?: 0)? | gnu org licenses agpl 3 0
gfdl-1.1 | gfdl | gfdl 1 1 | gnu free documentation LIC V1 1 | gnu org licenses (?:old licenses )?fdl 1 1
gfdl-1.2 | gfdl | gfdl 1 2 | gnu free documentation LIC V1 2 | gnu org licenses (?:old licenses )?fdl 1 2
gfdl-1.3 | gfdl | gfdl 1 3 | gnu free documentation LIC V1 3 | gnu org licenses fdl 1 3
mpl-1.0 | mozilla | mpl 1 0 | mozilla public LIC V1 0 | mozilla org mpl (?:mpl )?1 0
mpl-1.1 | mozilla | mpl 1 1 | mozilla public LIC V1 1 | mozilla org mpl (?:mpl )?1 1
mpl-2.0 | mozilla | mpl 2 0 | mozilla public LIC (?:version 2|v2|2)(?: 0)? | mozilla org mpl 2 0
epl-1.0 | eclipse | epl 1 0 | eclipse public LIC V1 0 | eclipse org legal epl v10
epl-2.0 | eclipse | epl 2 0 | eclipse public LIC (?:version 2|v2|2)(?: 0)? | eclipse org legal epl (?:2 0|v20)
cddl-1.0 | cddl | cddl 1 0 | common development and distribution LIC(?: cddl)? V1 0 | opensource org licenses cddl 1 0
cddl-1.1 | cddl | cddl 1 1 | common development and distribution LIC(?: cddl)? V1 1 | glassfish java net public cddl 1 1
cpl-1.0 | common | cpl 1 0 | common public LIC V1 0 | opensource org licenses cpl 1 0
ipl-1.0 | ibm | ipl 1 0 | ibm public LIC V1 0 | opensource org licenses ipl 1 0
eupl-1.1 | eupl | eupl 1 1 | european union public LIC(?: eupl)? V1 1 | opensource org licenses eupl 1 1
eupl-1.2 | eupl | eupl 1 2 | european union public LIC(?: eupl)? V1 2 | opensource org licenses eupl 1 2
artistic-1.0 | artistic | artistic 1 0 | (?:perl )?artistic LIC V1 0 | opensource org licenses artistic license 1 0
artistic-2.0 | artistic | artistic 2 0 | (?:perl )?artistic LIC V2 0 | opensource org licenses artistic license 2 0
bsl-1.0 | boost | bsl 1 0 | boost software LIC(?: V1 0)? | boost org license 1 0
busl-1.1 | business | busl 1 1 | business source LIC(?: V1 1)? | mariadb com bsl11
sspl-1.0 | sspl | sspl 1 0 | server side public LIC(?: V1(?: 0)?)? | mongodb com licensing server side public license
elastic-2.0 | elastic | elastic 2 0 | elastic LIC(?: V2 0)? | elastic co licensing elastic license
cc0-1.0 | cc0 | cc0 1 0 | cc0(?: 1 0)? universal(?: public domain dedication)?|cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by-2.0 | cc | cc by 2 0 | cc by 2 0 | creativecommons org licenses by 2 0
cc-by-3.0 | cc | cc by 3 0 | cc by 3 0 | creativecommons org licenses by 3 0
cc-by-4.0 | cc | cc by 4 0 | cc by 4 0 | creativecommons org licenses by 4 0
cc-by-sa-2.0 | cc | cc by sa 2 0 | cc by sa 2 0 | creativecommons org licenses by sa 2 0
cc-by-sa-3.0 | cc | cc by sa 3 0 | cc by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | cc | cc by sa 4 0 | cc by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-nd-4.0 | cc | cc by nd 4 0 | cc by nd 4 0 | creativecommons org licenses by nd 4 0
cc-by-nc-3.0 | cc | cc by nc 3 0 | cc by nc 3 0 | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | cc | cc by nc 4 0 | cc by nc 4 0 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0 | cc by nc sa 3 0 | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0 | cc by nc sa 4 0 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0 | cc by nc nd 4 0 | creativecommons org licenses by nc nd 4 0
odbl-1.0 | odbl | odbl 1 0 | open (?:data commons open )?database LIC(?: odbl)?(?: V1 0)? | opendatacommons org licenses odbl
odc-by-1.0 | odc | odc by 1 0 | open data commons attribution LIC(?: V1 0)? | opendatacommons org licenses by
pddl-1.0 | pddl | pddl 1 0 | public domain dedication and LIC(?: V1 0)? | opendatacommons org licenses pddl
unlicense | unlicense | unlicense | the unlicense | unlicense org
wtfpl | wtfpl | wtfpl | do what the fuck you want to public LIC | wtfpl net
zlib | zlib | zlib | zlib(?: libpng)? LIC | zlib net zlib license html
libpng | libpng | libpng | libpng LIC | libpng org pub png src libpng license txt
python-2.0 | python | python 2 0|psf 2 0 | python software foundation LIC(?: V2)? | docs python org 3 license html
php-3.01 | php | php 3 01 | php LIC V3 01 | php net license 3 01 txt
ruby | ruby | ruby | ruby LIC | ruby lang org en about license txt
postgresql | postgresql | postgresql | postgresql LIC | postgresql org about licence
openssl | openssl | openssl | openssl LIC | openssl org source license html
ofl-1.1 | ofl | ofl 1 1 | (?:sil )?open font LIC(?: V1 1)? | scripts sil org ofl
ncsa | ncsa | ncsa | university of illinois ncsa open source LIC | opensource org licenses ncsa
cecill-2.1 | cecill | cecill 2 1 | cecill (?:free software )?LIC(?: agreement)? V2 1 | cecill info licences licence cecill v2 1
ms-pl | microsoft | ms pl | microsoft public LIC(?: ms pl)? | opensource org licenses ms pl
ms-rl | microsoft | ms rl | microsoft reciprocal LIC(?: ms rl)? | opensource org licenses ms rl
afl-3.0 | academic | afl 3 0 | academic free LIC V3 0 | opensource org licenses afl 3 0
osl-3.0 | osl | osl 3 0 | open software LIC V3 0 | opensource org licenses osl 3 0
upl-1.0 | universal | upl 1 0 | universal permissive LIC(?: V1 0)? | opensource org licenses upl
mulan-2.0 | mulan | mulanpsl 2 0 | mulan permissive software LIC(?: V2)? | license coscl org cn mulanpsl2
ogl-3.0 | government | ogl uk 3 0 | open government LIC V3 0 | nationalarchives gov uk doc open government licence version 3
llama-2 | llama | llama2 | llama 2 community LIC(?: agreement)? | ai meta com llama license
openrail-m | openrail | openrail(?: m)? | (?:bigscience |creativeml )?(?:openrail|open rail) m LIC | huggingface co spaces bigscience license
gemma | gemma | gemma | gemma terms of use | ai google dev gemma terms
"""

# label | kind | words it needs | expression
_FURTHER = """
gpl-2.0-or-later | notice | general public later | general public LIC (?:as published by the free software foundation )?(?:either )?version 2 (?:0 )?(?:of the LIC )?or (?:at your option )?any later version
gpl-3.0-or-later | notice | general public later | general public LIC (?:as published by the free software foundation )?(?:either )?version 3 (?:0 )?(?:of the LIC )?or (?:at your option )?any later version
lgpl-2.1-or-later | notice | lesser public later | lesser general public LIC (?:as published by the free software foundation )?(?:either )?version 2 1 (?:of the LIC )?or (?:at your option )?any later version
lgpl-3.0-or-later | notice | lesser public later | lesser general public LIC (?:as published by the free software foundation )?(?:either )?version 3 (?:of the LIC )?or (?:at your option )?any later version
agpl-3.0-or-later | notice | affero public later | affero general public LIC (?:as published by the free software foundation )?(?:either )?version 3 (?:of the LIC )?or (?:at your option )?any later version
gpl-2.0-or-later | tag | spdx gpl later | spdx LIC identifier gpl 2 0 or later
gpl-3.0-or-later | tag | spdx gpl later | spdx LIC identifier gpl 3 0 or later
lgpl-2.1-or-later | tag | spdx lgpl later | spdx LIC identifier lgpl 2 1 or later
lgpl-3.0-or-later | tag | spdx lgpl later | spdx LIC identifier lgpl 3 0 or later
agpl-3.0-or-later | tag | spdx agpl later | spdx LIC identifier agpl 3 0 or later
mit | notice | permission hereby sublicense | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,400}? sublicense
mit | notice | warranty noninfringement | the software is provided as is without warranty of any kind .{0,300}? noninfringement
isc | notice | permission fee hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause | notice | redistribution binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | notice | neither endorse promote | neither the name of .{1,200}? (?:be used to )?endorse or promote products
bsd-4-clause | notice | advertising acknowledgement | all advertising materials mentioning features .{0,120}? acknowledgement
apache-2.0 | notice | apache compliance | licensed under the apache LIC version 2 0 the LIC you may not use this file except in compliance
gpl | notice | free redistribute modify gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public LIC
lgpl | notice | free redistribute modify lesser | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public LIC
mpl-2.0 | notice | mozilla subject form | this source code form is subject to the terms of the mozilla public LIC v 2 0
epl-2.0 | notice | eclipse accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public LIC
unlicense | notice | unencumbered domain | this is free and unencumbered software released into the public domain
public-domain | notice | dedicated public domain | (?:has been |is )?dedicated to the public domain
public-domain | name | public domain | (?:released|placed) (?:in|into) the public domain
public-domain | mention | public domain | (?:in|into) the public domain
zlib | notice | origin misrepresented | the origin of this software must not be misrepresented
bsl-1.0 | notice | distributed boost | distributed under the boost software LIC version 1 0
wtfpl | notice | fuck | you just do what the fuck you want to
x11 | notice | x consortium | except as contained in this notice the name of the x consortium
postgresql | notice | california postgresql | in no event shall the university of california be liable .{0,400}? postgresql
ofl-1.1 | notice | reserved font | with reserved font name
gfdl | notice | invariant sections | with no invariant sections no front cover texts and no back cover texts
cc0-1.0 | notice | waived copyright related | (?:has )?waived all copyright and related or neighboring rights
all-rights-reserved | notice | copyright rights reserved | copyright (?:c )?(?:[0-9]{4} )?.{0,80}? all rights reserved
all-rights-reserved | mention | rights reserved | all rights reserved
proprietary | notice | confidential proprietary | (?:this (?:document|software) is )?(?:confidential and proprietary|proprietary and confidential)
proprietary | name | proprietary | proprietary LIC
commercial | name | commercial | commercial LIC
evaluation | name | evaluation | evaluation LIC
end-user | name | user agreement | end user LIC agreement
end-user | mention | eula | eula
shareware | mention | shareware | shareware
freeware | mention | freeware | freeware
non-commercial | mention | commercial | for non commercial use only
non-commercial | mention | noncommercial | for noncommercial use only
research-only | mention | research | for research (?:purposes|use) only
apache | mention | apache | apache LIC
apache | mention | asl | asl (?:v2|2 0)
mit | mention | mit | (?:the )?mit LIC
mit | mention | expat | expat LIC
bsd | mention | bsd | bsd (?:style )?LIC
gpl | mention | gpl | (?:gnu )?gpl
gpl-2.0 | name | gplv2 | gplv2
gpl-3.0 | name | gplv3 | gplv3
gpl-2.0-or-later | name | gplv2 later | gplv2 or later
gpl-3.0-or-later | name | gplv3 later | gplv3 or later
gpl | mention | general public | gnu general public LIC
gpl-with-classpath | notice | classpath exception | (?:with the )?classpath exception
gpl-with-gcc-exception | notice | runtime library exception | gcc runtime library exception
lgpl | mention | lgpl | (?:gnu )?lgpl
lgpl-2.1 | name | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | name | lgplv3 | lgplv3
lgpl | mention | lesser public | (?:gnu )?lesser general public LIC
lgpl | mention | library public | gnu library general public LIC
agpl | mention | agpl | (?:gnu )?agpl
agpl-3.0 | name | agplv3 | agplv3
agpl | mention | affero public | (?:gnu )?affero general public LIC
gfdl | mention | gfdl | gfdl
gfdl | mention | documentation | (?:gnu )?free documentation LIC
mpl | mention | mozilla | mozilla public LIC
epl | mention | eclipse | eclipse public LIC
cddl | mention | cddl | cddl
cddl | mention | development distribution | common development and distribution LIC
eupl | mention | eupl | eupl
eupl | mention | european union | european union public LIC
artistic | mention | artistic | artistic LIC
cecill | mention | cecill | cecill
sspl | mention | server side | server side public LIC
psf | mention | psf | psf LIC
psf | mention | python | python LIC
php | mention | php | php LIC
ofl | mention | open font | (?:sil )?open font LIC
osl | mention | open software | open software LIC
ogl | mention | government | open government LIC
odbl | mention | odbl | odbl
wtfpl | mention | wtfpl | wtfpl
unlicense | mention | unlicense | unlicense
cc0 | mention | cc0 | cc0
cc | mention | creative commons | creative commons(?: LIC)?
cc-by | name | creative commons attribution | creative commons attribution(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by-sa | name | creative commons sharealike | creative commons attribution sharealike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by-sa | name | creative commons share alike | creative commons attribution share alike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by-nd | name | creative commons noderivatives | creative commons attribution noderivatives(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by-nd | name | creative commons derivatives | creative commons attribution no derivatives(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by-nc | name | creative commons noncommercial | creative commons attribution noncommercial(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by-nc | name | creative commons non commercial | creative commons attribution non commercial(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by-nc-sa | name | creative commons noncommercial sharealike | creative commons attribution noncommercial sharealike(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by-nc-nd | name | creative commons noncommercial noderivatives | creative commons attribution noncommercial noderivatives(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: LIC)?
cc-by | mention | cc by | cc by
cc-by-sa | mention | cc by sa | cc by sa
cc-by-nd | mention | cc by nd | cc by nd
cc-by-nc | mention | cc by nc | cc by nc
cc-by-nc-sa | mention | cc by nc sa | cc by nc sa
cc-by-nc-nd | mention | cc by nc nd | cc by nc nd
open-source | mention | osi | osi approved(?: LIC)?
open-source | mention | open source | open source LIC
free-software | mention | free software | free software LIC
"""

_VERB = "(?:licensed|released|distributed|available|provided|published|shared|offered|redistribute|redistributed|used)"
#: Words that a name needs, where they differ from those of the identifier.
_NAME_NEEDS = {
    "lgpl": ("general", "public"),
    "agpl": ("affero", "public"),
    "gfdl": ("documentation",),
    "cddl": ("development", "distribution"),
    "cpl": ("common", "public"),
    "ipl": ("ibm", "public"),
    "eupl": ("european", "union"),
    "sspl": ("server", "side"),
    "odbl": ("open", "database"),
    "odc": ("commons", "attribution"),
    "pddl": ("domain", "dedication"),
    "ofl": ("open", "font"),
    "osl": ("open", "software"),
    "wtfpl": ("fuck",),
    "openrail": ("m",),
    "mulan": ("mulan",),
}


def _first_words(pattern: str) -> tuple[str, ...]:
    """The plain words with which an expression without alternatives begins; all its matches have them."""
    words = []
    for w in pattern.split(" "):
        if not w.isalnum() or w == "LIC":
            break
        words.append(w)
    return tuple(words)


def compiled(pattern: str) -> str:
    """The expression over a text in which every word has a blank before and after it, so that matches
    consist of whole words and neighbours do not share a blank."""
    body = pattern.replace("LIC", _LIC).replace(" V", " " + _V)
    return " (?:" + body.replace(" ", "  ") + ") "


def _rules() -> list[Rule]:
    rules: list[Rule] = []
    for line in _LICENSES.strip().splitlines():
        label, need, tag, name, link = (x.strip() for x in line.split(" | "))
        words = tuple(need.split(" "))
        named = _NAME_NEEDS.get(words[0], words)
        first = _first_words(tag)[:1] if "|" not in tag else ()
        rules.append(Rule(label, TAG, ("spdx", "identifier", *first), f"spdx LIC identifier (?:{tag})"))
        rules.append(
            Rule(label, NOTICE, ("under", *named), f"{_VERB} (?:\\S+ ){{0,3}}?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})")
        )
        rules.append(Rule(label, NAME, named, f"(?:{name})"))
        rules.append(Rule(label, LINK, _first_words(link), link))
    for line in _FURTHER.strip().splitlines():
        label, kind, need, pattern = (x.strip() for x in line.split(" | "))
        rules.append(Rule(label, KINDS.index(kind), tuple(need.split(" ")), pattern))
    rules.sort(key=lambda r: r.kind)  # stable: the order of the file within a kind
    return [r._replace(need=tuple(dict.fromkeys(r.need)), pattern=compiled(r.pattern)) for r in rules]


RULES = _rules()
