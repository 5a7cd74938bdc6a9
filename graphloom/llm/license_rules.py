"""Signature rules for licences, as text: label | priority | keyword | pattern.

Patterns apply to lower-case words joined by single spaces, between word borders. Priority 1: identifiers and
defining clauses; 2: a name with its version; 3: a bare or family name. A rule is tried only where its keyword stands.
"""

from __future__ import annotations

RULES = r"""
mit|1|mit|spdx licen[cs]e identifier mit
mit|2|mit|(?:released|licen[cs]ed|distributed|available|published) under (?:the )?(?:terms of the )?mit(?: x11)? licen[cs]e
mit|3|mit|(?:the )?mit licen[cs]e(?: \(?expat\)?)?
mit|3|mit|licen[cs]e mit
mit|1|permission|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|2|expat|expat licen[cs]e
mit-0|1|mit|spdx licen[cs]e identifier mit 0
mit-0|2|mit|mit no attribution(?: licen[cs]e)?
x11|2|x11|x11 licen[cs]e
apache-2|1|apache|spdx licen[cs]e identifier apache 2(?: 0)?
apache-2|2|apache|apache (?:software )?licen[cs]e version 2(?: 0)?
apache-2|2|apache|apache (?:licen[cs]e )?(?:v ?)?2(?: 0)?(?: licen[cs]e)?
apache-2|1|apache|www apache org licenses license 2 0
apache-1|2|apache|apache (?:software )?licen[cs]e version 1(?: [01])?
apache-1|1|apache|spdx licen[cs]e identifier apache 1 [01]
apache|3|apache|apache (?:software )?licen[cs]e
gpl-3|1|gpl|spdx licen[cs]e identifier gpl 3 0(?: or later| only)?
gpl-3|2|general|gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?
gpl-3|2|gpl|gnu gpl (?:v |version )?3(?: 0)?
gpl-3|2|gpl|gpl (?:v |version )?3(?: 0)?(?: or later| only)?
gpl-3|2|gplv3|gplv3(?: or later)?
gpl-2|1|gpl|spdx licen[cs]e identifier gpl 2 0(?: or later| only)?
gpl-2|2|general|gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?
gpl-2|2|gpl|gnu gpl (?:v |version )?2(?: 0)?
gpl-2|2|gpl|gpl (?:v |version )?2(?: 0)?(?: or later| only)?
gpl-2|2|gplv2|gplv2(?: or later)?
gpl-1|2|general|gnu general public licen[cs]e version 1
gpl-1|1|gpl|spdx licen[cs]e identifier gpl 1 0(?: or later| only)?
gpl|3|general|gnu general public licen[cs]e
gpl|3|general|general public licen[cs]e
gpl|3|gpl|gnu gpl
gpl|3|gpl|(?:the )?gpl(?: licen[cs]e)?
lgpl-3|1|lgpl|spdx licen[cs]e identifier lgpl 3 0(?: or later| only)?
lgpl-3|2|lesser|gnu lesser general public licen[cs]e version 3(?: 0)?
lgpl-3|2|lgpl|(?:gnu )?lgpl (?:v |version )?3(?: 0)?
lgpl-3|2|lgplv3|lgplv3
lgpl-2.1|1|lgpl|spdx licen[cs]e identifier lgpl 2 1(?: or later| only)?
lgpl-2.1|2|lesser|gnu lesser general public licen[cs]e version 2 1
lgpl-2.1|2|lgpl|(?:gnu )?lgpl (?:v |version )?2 1
lgpl-2.1|2|lgplv2|lgplv2 1
lgpl-2|2|library|gnu library general public licen[cs]e(?: version 2(?: 0)?)?
lgpl-2|1|lgpl|spdx licen[cs]e identifier lgpl 2 0(?: or later| only)?
lgpl|3|lesser|(?:gnu )?lesser general public licen[cs]e
lgpl|3|lgpl|(?:gnu )?lgpl
agpl-3|1|agpl|spdx licen[cs]e identifier agpl 3 0(?: or later| only)?
agpl-3|2|affero|gnu affero general public licen[cs]e version 3(?: 0)?
agpl-3|2|agpl|(?:gnu )?agpl (?:v |version )?3(?: 0)?
agpl-3|2|agplv3|agplv3
agpl|3|affero|(?:gnu )?affero general public licen[cs]e
agpl|3|agpl|(?:gnu )?agpl
fdl|1|gfdl|spdx licen[cs]e identifier gfdl 1 [123](?: or later| only)?
fdl|2|documentation|gnu free documentation licen[cs]e(?: version 1 [123])?
fdl|3|gfdl|gfdl
bsd-2|1|bsd|spdx licen[cs]e identifier bsd 2 clause
bsd-2|2|bsd|bsd 2 clause(?: simplified)?(?: licen[cs]e)?
bsd-2|2|bsd|(?:2|two) clause bsd(?: licen[cs]e)?
bsd-2|2|bsd|simplified bsd licen[cs]e
bsd-2|2|freebsd|freebsd licen[cs]e
bsd-3|1|bsd|spdx licen[cs]e identifier bsd 3 clause(?: clear)?
bsd-3|2|bsd|bsd 3 clause(?: new)?(?: licen[cs]e)?
bsd-3|2|bsd|(?:3|three) clause bsd(?: licen[cs]e)?
bsd-3|2|bsd|(?:new|modified|revised) bsd licen[cs]e
bsd-3|1|endorse|neither the name of [^\n]{1,1000}? nor the names of (?:its|their) contributors may be used to endorse
bsd-4|1|bsd|spdx licen[cs]e identifier bsd 4 clause
bsd-4|2|bsd|(?:4|four) clause bsd(?: licen[cs]e)?
bsd-4|2|bsd|original bsd licen[cs]e
bsd-4|1|advertising|all advertising materials mentioning features or use of this software must display
bsd-0|2|bsd|(?:0|zero) clause bsd(?: licen[cs]e)?
bsd-0|1|0bsd|(?:spdx licen[cs]e identifier )?0bsd
bsd|1|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|3|bsd|(?:the )?bsd(?: style)? licen[cs]e
mpl-2|1|mpl|spdx licen[cs]e identifier mpl 2 0
mpl-2|2|mozilla|mozilla public licen[cs]e (?:v |version )?2(?: 0)?
mpl-2|2|mpl|mpl (?:v |version )?2(?: 0)?
mpl-1.1|1|mpl|spdx licen[cs]e identifier mpl 1 1
mpl-1.1|2|mozilla|mozilla public licen[cs]e (?:v |version )?1(?: [01])?
mpl-1.1|2|mpl|mpl (?:v |version )?1 1
mpl|3|mozilla|mozilla public licen[cs]e
epl-2|1|epl|spdx licen[cs]e identifier epl 2 0
epl-2|2|eclipse|eclipse public licen[cs]e (?:v |version )?2(?: 0)?
epl-1|1|epl|spdx licen[cs]e identifier epl 1 0
epl-1|2|eclipse|eclipse public licen[cs]e (?:v |version )?1(?: 0)?
epl|3|eclipse|eclipse public licen[cs]e
edl-1|2|eclipse|eclipse distribution licen[cs]e(?: version 1 0)?
cddl-1|1|cddl|spdx licen[cs]e identifier cddl 1 [01]
cddl-1|2|development|common development and distribution licen[cs]e(?: version 1 [01])?
cddl|3|cddl|cddl
cpl-1|2|common|common public licen[cs]e(?: version 1 0)?
cpl-1|1|cpl|spdx licen[cs]e identifier cpl 1 0
cpal-1|2|attribution|common public attribution licen[cs]e(?: version 1 0)?
ibm-public|2|ibm|ibm public licen[cs]e(?: version 1 0)?
apsl-2|2|apple|apple public source licen[cs]e(?: version)?(?: 2(?: 0)?)?
nokia|2|nokia|nokia open source licen[cs]e
sun-spl|2|sun|sun public licen[cs]e(?: version 1 0)?
isc|1|isc|spdx licen[cs]e identifier isc
isc|2|isc|isc licen[cs]e
isc|1|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib|1|zlib|spdx licen[cs]e identifier zlib
zlib|2|zlib|zlib(?: libpng)? licen[cs]e
zlib|1|warranty|this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng|2|libpng|libpng licen[cs]e(?: version 2)?
boost-1|1|bsl|spdx licen[cs]e identifier bsl 1 0
boost-1|2|boost|boost software licen[cs]e(?: version 1 0)?
busl-1.1|1|busl|spdx licen[cs]e identifier busl 1 1
busl-1.1|2|business|business source licen[cs]e(?: version)?(?: 1 1)?
elastic-2|2|elastic|elastic licen[cs]e(?: version)?(?: 2(?: 0)?)?
sspl-1|2|side|server side public licen[cs]e(?: version 1)?
sspl-1|3|sspl|sspl(?: v ?1)?
confluent|2|confluent|confluent community licen[cs]e(?: version 1 0)?
polyform-nc|2|polyform|polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-shield|2|polyform|polyform shield licen[cs]e(?: 1 0 0)?
polyform-strict|2|polyform|polyform strict licen[cs]e(?: 1 0 0)?
polyform|3|polyform|polyform [a-z]+ licen[cs]e
commons-clause|2|clause|commons clause(?: licen[cs]e condition)?
unlicense|1|unlicense|spdx licen[cs]e identifier unlicense
unlicense|2|unlicense|(?:the )?unlicense
unlicense|1|unencumbered|this is free and unencumbered software released into the public domain
wtfpl|2|wtfpl|wtfpl(?: version 2)?
wtfpl|1|want|do what the fuck you want to public licen[cs]e
beerware|2|beer|beer ?ware licen[cs]e
postgresql|2|postgresql|postgresql licen[cs]e
python-2|2|python|python software foundation licen[cs]e(?: version 2)?
python-2|2|psf|psf licen[cs]e(?: agreement)?(?: version 2)?
python-2|1|python|spdx licen[cs]e identifier python 2 0
php-3|2|php|php licen[cs]e(?: version)?(?: 3 0(?: 1)?)?
ruby|2|ruby|ruby licen[cs]e
perl-artistic-2|1|artistic|spdx licen[cs]e identifier artistic 2 0
perl-artistic-2|2|artistic|artistic licen[cs]e (?:v |version )?2(?: 0)?
perl-artistic-1|2|artistic|artistic licen[cs]e (?:v |version )?1(?: 0)?
perl-artistic|3|artistic|(?:perl )?artistic licen[cs]e
openssl|2|openssl|openssl licen[cs]e
ssleay|2|ssleay|ssleay licen[cs]e
openldap-2.8|2|openldap|openldap public licen[cs]e(?: version)?(?: 2 8)?
w3c|2|w3c|w3c(?: software)?(?: notice and)?(?: document)? licen[cs]e
vim|2|vim|vim licen[cs]e
tcl|2|tcl|tcl(?: tk)? licen[cs]e
curl|2|curl|curl licen[cs]e
ntp|2|ntp|ntp licen[cs]e
hpnd|2|historical|historical permission notice and disclaimer
icu|2|icu|icu licen[cs]e
unicode|2|unicode|unicode(?: inc)? licen[cs]e(?: agreement)?(?: v ?3)?
ncsa|2|ncsa|(?:university of illinois )?ncsa(?: open source)? licen[cs]e
ecl-2|2|educational|educational community licen[cs]e(?: version)?(?: 2(?: 0)?)?
afl-3|2|academic|academic free licen[cs]e(?: version)?(?: 3(?: 0)?)?
osl-3|2|licen|open software licen[cs]e(?: version)?(?: 3(?: 0)?)?
ms-pl|2|microsoft|microsoft public licen[cs]e
ms-rl|2|microsoft|microsoft reciprocal licen[cs]e
eupl-1.2|1|eupl|spdx licen[cs]e identifier eupl 1 2
eupl-1.2|2|european|european union public licen[cs]e(?: v ?| version )?(?:1 2)?
eupl-1.2|3|eupl|eupl(?: v ?1 2)?
cecill-2.1|2|cecill|cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version)?(?: 2(?: 1)?)?
cecill-b|2|cecill|cecill b(?: licen[cs]e)?
cecill-c|2|cecill|cecill c(?: licen[cs]e)?
mulan-psl-2|2|mulan|mulan (?:psl|permissive software licen[cs]e)(?: v ?2| version 2)?
ofl-1.1|1|ofl|spdx licen[cs]e identifier ofl 1 1
ofl-1.1|2|font|(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?
ofl-1.1|3|ofl|ofl 1 1
bitstream-vera|2|vera|bitstream vera(?: fonts?)? (?:licen[cs]e|copyright)
cc0|1|cc0|spdx licen[cs]e identifier cc0 1 0
cc0|2|cc0|cc0(?: 1 0)?(?: universal)?
cc0|2|cc|cc 0(?: 1 0)?
cc0|1|creative|creative commons zero(?: v ?1 0)?(?: universal)?
cc0|1|creativecommons|creativecommons org publicdomain zero 1 0
cc-by-nc-nd|1|cc|spdx licen[cs]e identifier cc by nc nd [1-4] 0
cc-by-nc-nd|2|cc|cc by nc nd(?: [1-4] 0)?
cc-by-nc-nd|2|creative|creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s?(?: [1-4] 0)?
cc-by-nc-nd|1|creativecommons|creativecommons org licenses by nc nd [1-4] 0
cc-by-nc-sa|1|cc|spdx licen[cs]e identifier cc by nc sa [1-4] 0
cc-by-nc-sa|2|cc|cc by nc sa(?: [1-4] 0)?
cc-by-nc-sa|2|creative|creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
cc-by-nc-sa|1|creativecommons|creativecommons org licenses by nc sa [1-4] 0
cc-by-nc|1|cc|spdx licen[cs]e identifier cc by nc [1-4] 0
cc-by-nc|2|cc|cc by nc(?: [1-4] 0)?
cc-by-nc|2|creative|creative commons attribution non ?commercial(?: [1-4] 0)?
cc-by-nc|1|creativecommons|creativecommons org licenses by nc [1-4] 0
cc-by-nd|1|cc|spdx licen[cs]e identifier cc by nd [1-4] 0
cc-by-nd|2|cc|cc by nd(?: [1-4] 0)?
cc-by-nd|2|creative|creative commons attribution no ?deriv(?:ative|ative work)?s?(?: [1-4] 0)?
cc-by-nd|1|creativecommons|creativecommons org licenses by nd [1-4] 0
cc-by-sa|1|cc|spdx licen[cs]e identifier cc by sa [1-4] 0
cc-by-sa|2|cc|cc by sa(?: [1-4] 0)?
cc-by-sa|2|creative|creative commons attribution share ?alike(?: [1-4] 0)?
cc-by-sa|1|creativecommons|creativecommons org licenses by sa [1-4] 0
cc-by|1|cc|spdx licen[cs]e identifier cc by [1-4] 0
cc-by|2|cc|cc by [1-4] 0
cc-by|3|cc|cc by
cc-by|2|creative|creative commons attribution(?: licen[cs]e)?(?: [1-4] 0)?
cc-by|1|creativecommons|creativecommons org licenses by [1-4] 0
creative-commons|3|creative|creative commons(?: licen[cs]e)?
odbl-1|1|odbl|spdx licen[cs]e identifier odbl 1 0
odbl-1|2|database|open (?:data commons open )?database licen[cs]e(?: v ?1 0)?
odbl-1|3|odbl|odbl
odc-by-1|2|odc|odc by(?: 1 0)?
odc-by-1|2|data|open data commons attribution licen[cs]e(?: v ?1 0)?
pddl-1|2|pddl|pddl(?: 1 0)?
pddl-1|2|dedication|public domain dedication and licen[cs]e
cdla-permissive-2|2|cdla|cdla permissive(?: (?:v ?)?2(?: 0)?)?
cdla-sharing-1|2|cdla|cdla sharing(?: (?:v ?)?1(?: 0)?)?
ogl-uk-3|2|government|open government licen[cs]e(?: v ?3(?: 0)?)?
etalab-2|2|etalab|etalab(?: open licen[cs]e)?(?: 2 0)?
openrail-m|2|openrail|(?:bigscience |creativeml )?openrail m(?: licen[cs]e)?
openrail-m|2|rail|open rail m(?: licen[cs]e)?
openrail-m|2|responsible|responsible ai licen[cs]e
llama-2|2|llama|llama 2 community licen[cs]e(?: agreement)?
llama-3|2|llama|(?:meta )?llama 3(?: [123])? community licen[cs]e(?: agreement)?
gemma|2|gemma|gemma terms of use
public-domain|2|domain|(?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain|3|domain|public domain
all-rights-reserved|2|reserved|all rights reserved
proprietary|2|proprietary|proprietary and confidential
proprietary|2|proprietary|proprietary licen[cs]e
eula|2|user|end user licen[cs]e agreement
eula|3|eula|eula
shareware|3|shareware|shareware
freeware|3|freeware|freeware
dual|2|dual|dual licen[cs]ed under
other-spdx|3|spdx|spdx licen[cs]e identifier [0-9a-z]+
""".strip()

#: The base phrases of the contract.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Every rule's match holds one of these letters or words; a text with none of them isn't looked at again.
GATES = ["licen", "attribution", "copyright", "permission", "redistribution", "advertising", "endorse", "warranty", "unencumbered", "public", "creative", "reserved", "proprietary", "freeware", "shareware", "apache", "clause"]
GATE_WORDS = ["spdx", "gpl", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "agpl", "agplv3", "gfdl", "0bsd", "mpl", "cddl", "sspl", "wtfpl", "eupl", "cecill", "eula", "odbl", "odc", "pddl", "cdla", "etalab", "openrail", "open", "gemma", "ofl", "historical", "mulan", "cc0", "cc"]


#: SPDX identifiers that have no rule of their own above.
SPDX = """
AFL-1.2 AFL-2.1 AFL-3.0 APL-1.0 APSL-2.0 Artistic-1.0-Perl BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause-Patent BSD-3-Clause-LBNL BSL-1.1 CATOSL-1.1
CC-PDDC CDLA-Permissive-1.0 CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.1 CECILL-B CECILL-C CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 CNRI-Python
CPAL-1.0 CUA-OPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 Entessa ErlPL-1.1 EUDatagrid EUPL-1.1 Fair Frameworx-1.0 FSFAP FSFUL FTL HPND ICU IJG Imlib2 Intel IPA IPL-1.0 JSON
Latex2e Libpng-2.0 LiLiQ-P-1.1 LiLiQ-R-1.1 LPL-1.02 LPPL-1.3c MirOS Motosoto MPL-1.0 MS-PL MS-RL MulanPSL-2.0 Multics NASA-1.3 Naumen NCSA NGPL Nokia NPOSL-3.0 NTP OCLC-2.0
ODC-By-1.0 OFL-1.0 OGL-UK-3.0 OGTSL OLDAP-2.8 OpenSSL OSET-PL-2.1 OSL-1.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 QPL-1.0 RPL-1.5 RPSL-1.0 RSCPL Ruby
SimPL-2.0 SISSL Sleepycat SPL-1.0 SSPL-1.0 TCL UCL-1.0 Unicode-3.0 Unicode-DFS-2016 UPL-1.0 Vim VSL-1.0 W3C Watcom-1.0 WTFPL X11 Xnet Zend-2.0 ZPL-2.1
""".split()


def rules() -> list[tuple[str, int, str, str]]:
    """Those of RULES, and for each of SPDX one that needs the identifier's words."""
    written = [(a, int(b), c, d) for a, b, c, d in (line.split("|", 3) for line in RULES.splitlines())]
    return written + [(x.lower(), 1, "spdx", "spdx licen[cs]e identifier " + x.lower().replace("-", " ").replace(".", " ")) for x in SPDX]
