"""Signature rules of licence notices, written by hand: in this order, one a line.

``priority | label | keyword | signature``. A signature is a regular expression over the words of a text, in lower case and with one
space between words; punctuation isn't there ("CC BY-NC 4.0" reads "cc by nc 4 0"). A rule is only tried where its keyword occurs.
What a rule must obey, and tests check: its keyword is in each of its matches, matches of one rule never overlap, no part of it is
unbounded, and it is plain enough for both Java's and RE2's syntax.

Priorities: 1 tags and named versions in a grant, 2 grants, 3 sentences of licence texts, 4 names, 5 hints.
"""

from __future__ import annotations

from typing import NamedTuple

#: What a label is worth that was found by a rule of the priority.
WEIGHTS = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.7, 5: 0.3}

_TEXT = """
1 | mit | spdx | spdx license identifier mit(?: 0)?
1 | apache-2.0 | spdx | spdx license identifier apache 2 0
1 | bsd-2-clause | spdx | spdx license identifier bsd 2 clause(?: patent)?
1 | bsd-3-clause | spdx | spdx license identifier bsd 3 clause(?: clear)?
1 | gpl-2.0-only | spdx | spdx license identifier gpl 2 0(?: only)?
1 | gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
1 | gpl-3.0-only | spdx | spdx license identifier gpl 3 0(?: only)?
1 | gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
1 | lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
1 | lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
1 | lgpl-3.0-only | spdx | spdx license identifier lgpl 3 0(?: only)?
1 | lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
1 | agpl-3.0-only | spdx | spdx license identifier agpl 3 0(?: only)?
1 | agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
1 | mpl-2.0 | spdx | spdx license identifier mpl 2 0
1 | epl-1.0 | spdx | spdx license identifier epl 1 0
1 | epl-2.0 | spdx | spdx license identifier epl 2 0
1 | isc | spdx | spdx license identifier isc
1 | unlicense | spdx | spdx license identifier unlicense
1 | zlib | spdx | spdx license identifier zlib
1 | bsl-1.0 | spdx | spdx license identifier bsl 1 0
1 | cc0-1.0 | spdx | spdx license identifier cc0 1 0
1 | cc-by-4.0 | spdx | spdx license identifier cc by 4 0
1 | cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
1 | artistic-2.0 | spdx | spdx license identifier artistic 2 0
1 | wtfpl | spdx | spdx license identifier wtfpl
1 | eupl-1.2 | spdx | spdx license identifier eupl 1 2
1 | 0bsd | spdx | spdx license identifier 0bsd
1 | ofl-1.1 | spdx | spdx license identifier ofl 1 1
1 | proprietary | spdx | spdx license identifier (?:licenseref )?(?:proprietary|commercial)
1 | apache-2.0 | apache | licen[sc]ed under (?:the )?(?:terms of )?apache(?: software)?(?: licen[sc]e)?(?: v| version)? v?2(?: 0)?
1 | apache-2.0 | apache | licen[sc]ed under the apache licen[sc]e version 2 0
1 | apache-1.1 | apache | licen[sc]ed under the apache(?: software)? licen[sc]e version 1 1
1 | gpl-1.0 | general | licen[sc]ed under (?:the )?gnu general public license(?: v| version) 1(?: 0)?
1 | gpl-2.0 | general | licen[sc]ed under (?:the )?(?:terms of the )?gnu general public license(?: gpl)?(?: v| version) 2(?: 0)?
1 | gpl-3.0 | general | licen[sc]ed under (?:the )?(?:terms of the )?gnu general public license(?: gpl)?(?: v| version) 3(?: 0)?
1 | gpl-2.0 | gplv2 | licen[sc]ed under (?:the )?(?:gnu )?gplv2
1 | gpl-3.0 | gplv3 | licen[sc]ed under (?:the )?(?:gnu )?gplv3
1 | lgpl-2.1 | lesser | licen[sc]ed under (?:the )?(?:terms of the )?gnu lesser general public license(?: lgpl)?(?: v| version) 2 1
1 | lgpl-3.0 | lesser | licen[sc]ed under (?:the )?(?:terms of the )?gnu lesser general public license(?: lgpl)?(?: v| version) 3(?: 0)?
1 | agpl-3.0 | affero | licen[sc]ed under (?:the )?(?:terms of the )?gnu affero general public license(?: agpl)?(?: v| version) 3(?: 0)?
1 | mpl-1.1 | mozilla | subject to the mozilla public license version 1 1
1 | mpl-2.0 | mozilla | subject to the terms of the mozilla public license v(?:ersion)? 2 0
1 | mpl-2.0 | mozilla | licen[sc]ed under (?:the )?mozilla public license(?: v| version)? 2 0
1 | epl-1.0 | eclipse | terms of the eclipse public license(?: v| version)? v?1 0
1 | epl-2.0 | eclipse | terms of the eclipse public license(?: v| version)? v?2 0
1 | cddl-1.0 | cddl | licen[sc]ed under (?:the )?cddl(?: v| version)? 1 0
1 | cc-by-4.0 | cc | licen[sc]ed under (?:an? |the )?cc by 4 0
1 | cc-by-4.0 | creative | licen[sc]ed under (?:an? |the )?creative commons attribution 4 0
1 | cc-by-3.0 | cc | licen[sc]ed under (?:an? |the )?cc by 3 0
1 | cc-by-sa-4.0 | cc | licen[sc]ed under (?:an? |the )?cc by sa 4 0
1 | cc-by-sa-3.0 | cc | licen[sc]ed under (?:an? |the )?cc by sa 3 0
1 | cc-by-nc-4.0 | cc | licen[sc]ed under (?:an? |the )?cc by nc 4 0
1 | cc-by-nc-3.0 | cc | licen[sc]ed under (?:an? |the )?cc by nc 3 0
1 | cc-by-nd-4.0 | cc | licen[sc]ed under (?:an? |the )?cc by nd 4 0
1 | cc-by-nc-sa-4.0 | cc | licen[sc]ed under (?:an? |the )?cc by nc sa 4 0
1 | cc-by-nc-nd-4.0 | cc | licen[sc]ed under (?:an? |the )?cc by nc nd 4 0
1 | cc-by-4.0 | commons | creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
1 | cc-by-3.0 | commons | creative commons attribution 3 0(?: unported)?(?: license)?
1 | cc-by-2.0 | commons | creative commons attribution 2 [05](?: generic)?(?: license)?
1 | cc-by-sa-4.0 | sharealike | creative commons attribution sharealike 4 0(?: international)?(?: public)?(?: license)?
1 | cc-by-sa-3.0 | sharealike | creative commons attribution sharealike 3 0(?: unported)?(?: license)?
1 | cc-by-nc-4.0 | noncommercial | creative commons attribution noncommercial 4 0(?: international)?(?: public)?(?: license)?
1 | cc-by-nc-3.0 | noncommercial | creative commons attribution noncommercial 3 0(?: unported)?(?: license)?
1 | cc-by-nd-4.0 | noderivatives | creative commons attribution noderivatives 4 0(?: international)?(?: public)?(?: license)?
1 | cc-by-nc-sa-4.0 | sharealike | creative commons attribution noncommercial sharealike 4 0(?: international)?(?: public)?(?: license)?
1 | cc-by-nc-nd-4.0 | noderivatives | creative commons attribution noncommercial noderivatives 4 0(?: international)?(?: public)?(?: license)?
1 | cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
1 | cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
1 | cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
1 | cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
1 | cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
1 | cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
1 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
1 | public-domain | creativecommons | creativecommons org publicdomain mark 1 0
1 | apache-2.0 | apache | apache org licenses license 2 0(?: txt| html)?
1 | mit | opensource | opensource org licenses? mit(?: license)?(?: php| html)?
1 | bsd-2-clause | opensource | opensource org licenses? bsd 2 clause
1 | bsd-3-clause | opensource | opensource org licenses? bsd 3 clause
1 | isc | opensource | opensource org licenses? isc
1 | gpl-2.0 | gnu | gnu org licenses (?:old licenses )?gpl 2 0
1 | gpl-3.0 | gnu | gnu org licenses gpl 3 0
1 | lgpl-2.1 | gnu | gnu org licenses (?:old licenses )?lgpl 2 1
1 | lgpl-3.0 | gnu | gnu org licenses lgpl 3 0
1 | agpl-3.0 | gnu | gnu org licenses agpl 3 0
1 | mpl-2.0 | mozilla | mozilla org mpl 2 0
1 | epl-2.0 | eclipse | eclipse org legal epl (?:2 0|v20)
1 | bsl-1.0 | boost | boost org license 1 0(?: txt)?
1 | unlicense | unlicense | unlicense org
1 | wtfpl | wtfpl | wtfpl net
2 | mit | mit | licen[sc]ed under (?:the )?(?:terms of the )?mit(?: expat)?(?: open source)?(?: licen[sc]e)?
2 | mit | mit | released under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?
2 | mit | mit | distributed under (?:the )?(?:terms of the )?mit(?: software)?(?: licen[sc]e)?
2 | mit | mit | available under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?
2 | mit | mit | governed by (?:the|an) mit(?: style)? licen[sc]e
2 | apache | apache | licen[sc]ed under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[sc]e)?
2 | apache | apache | released under (?:the )?(?:terms of the )?apache(?: software)? licen[sc]e
2 | apache | apache | distributed under (?:the )?(?:terms of the )?apache(?: software)? licen[sc]e
2 | bsd | bsd | licen[sc]ed under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: licen[sc]e)?
2 | bsd | bsd | released under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: licen[sc]e)?
2 | bsd | bsd | distributed under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: licen[sc]e)?
2 | bsd-3-clause | bsd | licen[sc]ed under (?:the |a )?(?:3|three) clause bsd(?: licen[sc]e)?
2 | bsd-2-clause | bsd | licen[sc]ed under (?:the |a )?(?:2|two) clause bsd(?: licen[sc]e)?
2 | gpl | general | licen[sc]ed under (?:the )?(?:terms of the )?gnu general public licen[sc]e
2 | gpl | gpl | licen[sc]ed under (?:the )?(?:terms of the )?(?:gnu )?gpl
2 | gpl | gpl | released under (?:the )?(?:terms of the )?(?:gnu )?gpl
2 | gpl | general | released under (?:the )?(?:terms of the )?gnu general public licen[sc]e
2 | lgpl | lgpl | licen[sc]ed under (?:the )?(?:terms of the )?(?:gnu )?lgpl
2 | lgpl | lesser | licen[sc]ed under (?:the )?(?:terms of the )?gnu lesser general public licen[sc]e
2 | agpl | agpl | licen[sc]ed under (?:the )?(?:terms of the )?(?:gnu )?agpl
2 | agpl | affero | licen[sc]ed under (?:the )?(?:terms of the )?gnu affero general public licen[sc]e
2 | mpl | mozilla | licen[sc]ed under (?:the )?(?:terms of the )?mozilla public licen[sc]e
2 | epl | eclipse | licen[sc]ed under (?:the )?(?:terms of the )?eclipse public licen[sc]e
2 | isc | isc | licen[sc]ed under (?:the )?(?:terms of the )?isc(?: licen[sc]e)?
2 | zlib | zlib | licen[sc]ed under (?:the )?(?:terms of the )?zlib(?: libpng)?(?: licen[sc]e)?
2 | bsl-1.0 | boost | (?:distributed|licen[sc]ed) under the boost software licen[sc]e(?: version 1 0)?
2 | artistic | artistic | (?:distributed|licen[sc]ed) under the artistic licen[sc]e(?: 2 0)?
2 | wtfpl | wtfpl | (?:released|licen[sc]ed) under the wtfpl
2 | unlicense | unlicense | (?:released|licen[sc]ed) under the unlicense
2 | eupl | eupl | licen[sc]ed under the eupl(?: v| version)?(?: 1)?(?: [12])?
2 | eupl | union | licen[sc]ed under the european union public licen[sc]e
2 | cddl | development | licen[sc]ed under (?:the )?common development and distribution licen[sc]e
2 | ofl-1.1 | sil | licen[sc]ed under the sil open font licen[sc]e(?: version 1 1)?
2 | gfdl | documentation | licen[sc]ed under (?:the )?(?:terms of the )?gnu free documentation licen[sc]e
2 | odbl | database | licen[sc]ed under (?:the )?open (?:data commons open )?database licen[sc]e
2 | cc | creative | licen[sc]ed under (?:an? |the )?creative commons(?: licen[sc]e)?
2 | cc-by | cc | licen[sc]ed under (?:an? |the )?cc by
2 | cc-by-sa | cc | licen[sc]ed under (?:an? |the )?cc by sa
2 | cc-by-nc | cc | licen[sc]ed under (?:an? |the )?cc by nc
2 | cc-by-nd | cc | licen[sc]ed under (?:an? |the )?cc by nd
2 | cc0 | cc0 | (?:released|licen[sc]ed|dedicated) under (?:the )?cc0
2 | proprietary | proprietary | licen[sc]ed under (?:a |the )?proprietary licen[sc]e
2 | commercial | commercial | licen[sc]ed under (?:a |the )?commercial licen[sc]e
2 | public-domain | domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
2 | public-domain | domain | this (?:work|file|software|code|document|text) is in the public domain
2 | dual | dual | dual licen[sc]ed under (?:the )?(?:mit|bsd|apache|gpl|lgpl)(?: 2 0)?(?: and| or)(?: the)? (?:mit|bsd|apache|gpl|lgpl)
3 | mit | charge | permission is hereby granted free of charge to any person obtaining a copy
3 | mit | merchantability | provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
3 | mit | substantial | shall be included in all copies or substantial portions
3 | mit | sublicense | rights to use copy modify merge publish distribute sublicense
3 | mit | noninfringement | fitness for a particular purpose and noninfringement
3 | isc | fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3 | isc | isc | the software is provided as is and isc disclaims
3 | isc | author | provided as is and the author disclaims all warranties
3 | hpnd | documentation | permission to use copy modify and distribute this software and its documentation for any purpose
3 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
3 | bsd | redistributions | redistributions of source code must retain the above copyright notice
3 | bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
3 | bsd-3-clause | neither | neither the name of (?:the )?(?:copyright holder|author|authors|university|company)
3 | bsd-3-clause | endorse | may be used to endorse or promote products derived from this software
3 | bsd | contributors | provided by the copyright holders and contributors as is
3 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software
3 | bsd | contributors | in no event shall the copyright (?:holder|owner|holders|owners) or contributors be liable
3 | apache-2.0 | compliance | you may not use this file except in compliance with the license
3 | apache-2.0 | warranties | distributed on an as is basis without warranties or conditions of any kind
3 | apache-2.0 | applicable | unless required by applicable law or agreed to in writing software
3 | apache-2.0 | governing | see the license for the specific language governing permissions and limitations
3 | apache-2.0 | terms | terms and conditions for use reproduction and distribution
3 | apache-2.0 | perpetual | perpetual worldwide non exclusive no charge royalty free irrevocable
3 | gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
3 | gpl | foundation | as published by the free software foundation
3 | gpl-2.0-or-later | option | either version 2 of the license or at your option any later version
3 | gpl-3.0-or-later | option | either version 3 of the license or at your option any later version
3 | lgpl-2.1-or-later | option | either version 2 1 of the license or at your option any later version
3 | gpl | hope | distributed in the hope that it will be useful
3 | gpl | merchantability | without even the implied warranty of merchantability
3 | gpl | received | you should have received a copy of the gnu general public license
3 | lgpl | received | you should have received a copy of the gnu lesser general public license
3 | agpl | received | you should have received a copy of the gnu affero general public license
3 | gpl | verbatim | everyone is permitted to copy and distribute verbatim copies
3 | agpl | network | interacting with it remotely through a computer network
3 | lgpl | library | this library is free software
3 | gpl | program | this program is free software
3 | mpl | mozilla | contents of this file are subject to the mozilla public license
3 | mpl-2.0 | incompatible | incompatible with secondary licenses
3 | mpl-2.0 | copy | if a copy of the mpl was not distributed with this file
3 | epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse
3 | cddl | development | subject to the terms of the common development and distribution license
3 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
3 | unlicense | publish | anyone is free to copy modify publish use compile sell or distribute
3 | wtfpl | fuck | do what the fuck you want to(?: public license)?
3 | zlib | misrepresented | the origin of this software must not be misrepresented
3 | zlib | altered | altered source versions must be plainly marked as such
3 | bsl-1.0 | executable | machine executable object code generated by a source language processor
3 | artistic | package | intent of this document is to state the conditions under which a package may be copied
3 | cc0 | waived | has waived all copyright and related or neighboring rights
3 | cc0 | dedicated | dedicated the work to the public domain by waiving all
3 | cc-by | credit | you must give appropriate credit provide a link to the license
3 | cc-by-nc | commercial | you may not use the material for commercial purposes
3 | cc-by-nd | modified | you may not distribute the modified material
3 | cc-by-sa | contributions | you must distribute your contributions under the same license as the original
3 | ofl-1.1 | font | permission is hereby granted free of charge to any person obtaining a copy of the font software
3 | gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
3 | json | evil | the software shall be used for good not evil
3 | beerware | beer | you can buy me a beer in return
3 | ms-pl | governs | this license governs use of the accompanying software
3 | proprietary | confidential | proprietary and confidential
3 | proprietary | confidential | confidential and proprietary
3 | proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|work|software|material)
3 | proprietary | reproduced | no part of this (?:publication|book|work|document) may be reproduced
3 | proprietary | written | without (?:the )?(?:express |prior )?(?:prior |express )?written (?:permission|consent)
4 | mit | mit | mit(?: x11)? licen[sc]e
4 | mit | expat | expat licen[sc]e
4 | apache-2.0 | apache | apache(?: software)?(?: licen[sc]e)?(?: v| version)? 2 0(?: licen[sc]e)?
4 | apache | apache | apache(?: software)? licen[sc]e
4 | asl-2.0 | asl | asl 2 0
4 | bsd-3-clause | bsd | bsd (?:3|three) clause(?: licen[sc]e)?
4 | bsd-2-clause | bsd | bsd (?:2|two) clause(?: licen[sc]e)?
4 | bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[sc]e
4 | bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[sc]e
4 | bsd | bsd | bsd(?: style)? licen[sc]e
4 | gpl-1.0 | general | gnu general public license(?: v| version) 1
4 | gpl-2.0 | general | gnu general public license(?: v| version) 2(?: 0)?
4 | gpl-3.0 | general | gnu general public license(?: v| version) 3(?: 0)?
4 | gpl-2.0 | gplv2 | gplv2
4 | gpl-3.0 | gplv3 | gplv3
4 | gpl-2.0 | gpl | gpl (?:version )?v?2(?: 0)?
4 | gpl-3.0 | gpl | gpl (?:version )?v?3(?: 0)?
4 | gpl | gpl | gpl
4 | lgpl | lgpl | lgpl
4 | lgpl-2.1 | lgpl | lgpl (?:version )?v?2 1
4 | lgpl-3.0 | lgpl | lgpl (?:version )?v?3(?: 0)?
4 | lgpl | lesser | (?:gnu )?lesser general public licen[sc]e
4 | lgpl-2.0 | library | gnu library general public licen[sc]e
4 | agpl | agpl | agpl
4 | agpl-3.0 | agplv3 | agplv3
4 | lgpl-3.0 | lgplv3 | lgplv3
4 | agpl-3.0 | affero | (?:gnu )?affero general public license(?: v| version) 3(?: 0)?
4 | agpl | affero | (?:gnu )?affero general public licen[sc]e
4 | mpl-1.1 | mozilla | mozilla public license(?: v| version)? 1 1
4 | mpl-2.0 | mozilla | mozilla public license(?: v| version)? 2 0
4 | mpl | mozilla | mozilla public licen[sc]e
4 | mpl-2.0 | mpl | mpl 2 0
4 | epl | eclipse | eclipse public licen[sc]e
4 | cpl-1.0 | common | common public license(?: v| version)? 1 0
4 | cddl | development | common development and distribution licen[sc]e
4 | isc | isc | isc licen[sc]e
4 | zlib | zlib | zlib(?: libpng)? licen[sc]e
4 | bsl-1.0 | boost | boost software licen[sc]e
4 | artistic | artistic | (?:perl )?artistic licen[sc]e
4 | psf-2.0 | python | python software foundation licen[sc]e
4 | php-3.01 | php | php license(?: version)? 3 01
4 | ruby | ruby | ruby licen[sc]e
4 | openssl | openssl | openssl licen[sc]e
4 | eupl | eupl | eupl
4 | ofl-1.1 | font | (?:sil )?open font licen[sc]e
4 | gfdl | gfdl | gfdl
4 | gfdl | documentation | gnu free documentation licen[sc]e
4 | odbl | odbl | odbl
4 | ms-pl | microsoft | microsoft public licen[sc]e
4 | ms-rl | reciprocal | microsoft reciprocal licen[sc]e
4 | busl-1.1 | business | business source licen[sc]e(?: 1 1)?
4 | sspl-1.0 | server | server side public licen[sc]e
4 | elastic-2.0 | elastic | elastic licen[sc]e(?: 2 0)?
4 | wtfpl | wtfpl | wtfpl
4 | unlicense | unlicense | the unlicense
4 | beerware | beerware | beerware
4 | cc0 | cc0 | cc0(?: 1 0)?(?: universal)?
4 | cc-by | cc | cc by(?: [1-4] [05])?
4 | cc-by-sa | cc | cc by sa(?: [1-4] [05])?
4 | cc-by-nc | cc | cc by nc(?: [1-4] [05])?
4 | cc-by-nd | cc | cc by nd(?: [1-4] [05])?
4 | cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
4 | cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
4 | cc | creative | creative commons(?: licen[sc]e)?
4 | public-domain | domain | public domain(?: dedication)?
5 | reserved | rights | (?:all|some|no) rights reserved
5 | copyright | copyright | copyright(?: c)? (?:19|20)[0-9][0-9]
5 | copyright | copyright | copyright (?:holder|holders|owner|owners)
5 | copyright | notice | copyright notice
5 | licence-file | see | see (?:the )?(?:license|licence|copying)(?: md| txt)?(?: file)?(?: for details)
5 | open-source | open | open source licen[sc]e
5 | open-source | copyleft | copyleft
5 | royalty-free | royalty | royalty free
5 | commercial | commercial | commercial licen[sc]e
5 | proprietary | proprietary | proprietary licen[sc]e
5 | terms | terms | terms (?:of use|of service|and conditions)
5 | eula | eula | eula
5 | eula | user | end user licen[sc]e agreement
5 | non-commercial | commercial | non commercial use only
5 | warranty | warranty | without (?:any )?warranty
"""


class Rule(NamedTuple):
    rule: int
    priority: int
    label: str
    keyword: str
    signature: str

    @property
    def pattern(self) -> str:
        """Over words that each have a space of their own on either side, so that neighbours share none."""
        return " " + self.signature.replace(" ", "  ") + " "


def parse(text: str) -> list[Rule]:
    """Rules from lines, numbered in their order."""
    rows = [[x.strip() for x in line.split(" | ")] for line in text.splitlines() if line.strip()]
    return [Rule(k, int(priority), label, keyword, signature) for k, (priority, label, keyword, signature) in enumerate(rows)]


RULES = parse(_TEXT)
