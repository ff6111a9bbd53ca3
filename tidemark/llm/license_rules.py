"""Signature rules of the license scan, written by hand.

A line: priority | confidence | label | keyword | signature. Signatures are regular expressions over lower-case words
joined by single spaces ('version 2.0' is 'version 2 0'); they match whole words. The keyword is a word that every match
contains, so a text without it never meets the rule. Where detections overlap, one inside another of the same or a
higher priority goes: 3 named and versioned licenses, 2 named ones, 1 wording typical of a license, 0 notices.
"""

from __future__ import annotations

#: What the contract's base looks for: label and consecutive words.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))

TEXT = r"""
3|0.99|gpl-3.0|gnu|gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version|v) 3(?: 0)?
3|0.99|gpl-2.0|gnu|gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version|v) 2(?: 0)?
3|0.99|gpl-1.0|gnu|gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?(?:version|v) 1(?: 0)?
3|0.99|gpl-3.0-or-later|gnu|gnu general public licen[sc]e (?:as published by the free software foundation )?either version 3 of the licen[sc]e or (?:at your option )?any later version
3|0.99|gpl-2.0-or-later|gnu|gnu general public licen[sc]e (?:as published by the free software foundation )?either version 2 of the licen[sc]e or (?:at your option )?any later version
3|0.98|gpl-3.0|gpl|gpl (?:version |v )?3(?: 0)?
3|0.98|gpl-2.0|gpl|gpl (?:version |v )?2(?: 0)?
3|0.98|gpl-3.0|gplv3|(?:gnu )?gplv3
3|0.98|gpl-2.0|gplv2|(?:gnu )?gplv2
3|0.98|gpl-3.0-or-later|gplv3|(?:gnu )?gplv3 or later
3|0.98|gpl-2.0-or-later|gplv2|(?:gnu )?gplv2 or later
3|0.99|gpl-3.0-only|gpl|gpl 3 0 only
3|0.99|gpl-2.0-only|gpl|gpl 2 0 only
3|0.99|gpl-3.0-or-later|gpl|gpl 3 0 or later
3|0.99|gpl-2.0-or-later|gpl|gpl 2 0 or later
2|0.95|gpl|gnu|gnu general public licen[sc]e
2|0.9|gpl|gnu|gnu gpl
2|0.9|gpl|public|general public licen[sc]e
2|0.7|gpl|gpl|(?:the )?gpl licen[sc]e
3|0.99|lgpl-3.0|lesser|gnu lesser general public licen[sc]e (?:version|v) 3(?: 0)?
3|0.99|lgpl-2.1|lesser|gnu lesser general public licen[sc]e (?:version|v) 2 1
3|0.99|lgpl-2.0|library|gnu library general public licen[sc]e (?:version|v) 2(?: 0)?
3|0.98|lgpl-3.0|lgpl|lgpl (?:version |v )?3(?: 0)?
3|0.98|lgpl-2.1|lgpl|lgpl (?:version |v )?2 1
3|0.98|lgpl-3.0|lgplv3|lgplv3
3|0.98|lgpl-2.1|lgplv2|lgplv2 1
2|0.95|lgpl|lesser|(?:gnu )?lesser general public licen[sc]e
2|0.95|lgpl|library|(?:gnu )?library general public licen[sc]e
2|0.85|lgpl|lgpl|(?:gnu )?lgpl
3|0.99|agpl-3.0|affero|gnu affero general public licen[sc]e (?:version|v) 3(?: 0)?
3|0.98|agpl-3.0|agpl|agpl (?:version |v )?3(?: 0)?
3|0.98|agpl-3.0|agplv3|agplv3
2|0.95|agpl|affero|(?:gnu )?affero general public licen[sc]e
2|0.85|agpl|agpl|(?:gnu )?agpl
3|0.99|gfdl-1.3|documentation|gnu free documentation licen[sc]e (?:version|v) 1 3
3|0.99|gfdl-1.2|documentation|gnu free documentation licen[sc]e (?:version|v) 1 2
3|0.99|gfdl-1.1|documentation|gnu free documentation licen[sc]e (?:version|v) 1 1
2|0.95|gfdl|documentation|(?:gnu )?free documentation licen[sc]e
2|0.85|gfdl|gfdl|gfdl
3|0.99|apache-2.0|apache|apache licen[sc]e (?:version |v )?2(?: 0)?
3|0.99|apache-1.1|apache|apache (?:software )?licen[sc]e (?:version |v )?1 1
3|0.99|apache-1.0|apache|apache (?:software )?licen[sc]e (?:version |v )?1 0
3|0.98|apache-2.0|apache|apache 2 0(?: licen[sc]e)?
3|0.98|apache-2.0|apache|licen[sc]ed under apache 2
3|0.98|apache-2.0|asl|(?:licen[sc]e|licen[sc]ed under(?: the)?) asl 2 0
3|0.98|apache-2.0|asl|asl 2 0 licen[sc]e
2|0.95|apache|apache|apache (?:software )?licen[sc]e
2|0.9|apache|apache|licen[sc]ed (?:to you )?under (?:the )?apache
3|0.97|apache-2.0|apache|www apache org licenses license 2 0
3|0.99|mit|mit|mit licen[sc]e
3|0.97|mit|mit|licen[sc]ed under (?:the )?(?:terms of the )?mit(?: x11)?
3|0.97|mit|mit|mit x11 licen[sc]e
3|0.97|mit|expat|expat licen[sc]e
3|0.96|mit|opensource|opensource org licenses mit
1|0.9|mit|permission|permission is hereby granted free of charge to any person obtaining a copy
3|0.98|mit-0|mit|mit no attribution licen[sc]e
3|0.98|mit-0|mit|(?:licen[sc]e(?: identifier)?|licen[sc]ed under(?: the)?) mit 0
3|0.98|mit-0|mit|mit 0 licen[sc]e
2|0.8|x11|x11|x11 licen[sc]e
3|0.99|bsd-3-clause|bsd|bsd 3 clause(?: licen[sc]e)?
3|0.99|bsd-3-clause|bsd|(?:new|revised|modified) bsd licen[sc]e
3|0.98|bsd-3-clause|clause|(?:3|three) clause bsd(?: licen[sc]e)?
3|0.99|bsd-2-clause|bsd|bsd 2 clause(?: licen[sc]e)?
3|0.99|bsd-2-clause|bsd|(?:simplified|freebsd) bsd licen[sc]e
3|0.98|bsd-2-clause|clause|(?:2|two) clause bsd(?: licen[sc]e)?
3|0.99|bsd-4-clause|bsd|bsd 4 clause(?: licen[sc]e)?
3|0.98|bsd-4-clause|bsd|(?:original|old) bsd licen[sc]e
3|0.98|0bsd|clause|(?:0|zero) clause bsd(?: licen[sc]e)?
3|0.97|0bsd|0bsd|0bsd
2|0.95|bsd|bsd|bsd (?:style )?licen[sc]e
2|0.85|bsd|bsd|licen[sc]ed under (?:the )?bsd
1|0.85|bsd|redistribution|redistribution and use in source and binary forms with or without modification are permitted
3|0.98|isc|isc|isc licen[sc]e
1|0.85|isc|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3|0.98|zlib|zlib|zlib licen[sc]e
3|0.98|zlib|zlib|zlib libpng licen[sc]e
3|0.98|libpng|libpng|libpng licen[sc]e
1|0.8|zlib|altered|altered source versions must be plainly marked as such
3|0.98|unlicense|unlicense|(?:the )?unlicense
1|0.9|unlicense|unencumbered|free and unencumbered software released into the public domain
3|0.98|wtfpl|wtfpl|wtfpl
3|0.98|wtfpl|want|do what the f\S* you want to public licen[sc]e
3|0.98|bsl-1.0|boost|boost software licen[sc]e(?: version)? 1 0
2|0.95|bsl-1.0|boost|boost software licen[sc]e
3|0.99|mpl-2.0|mozilla|mozilla public licen[sc]e (?:version |v )?2 0
3|0.99|mpl-1.1|mozilla|mozilla public licen[sc]e (?:version |v )?1 1
3|0.99|mpl-1.0|mozilla|mozilla public licen[sc]e (?:version |v )?1 0
3|0.97|mpl-2.0|mpl|mpl (?:v )?2 0
3|0.97|mpl-1.1|mpl|mpl (?:v )?1 1
2|0.95|mpl|mozilla|mozilla public licen[sc]e
2|0.8|mpl|mpl|mpl licen[sc]e
3|0.99|epl-2.0|eclipse|eclipse public licen[sc]e (?:version |v )?2 0
3|0.99|epl-1.0|eclipse|eclipse public licen[sc]e (?:version |v )?1 0
2|0.95|epl|eclipse|eclipse public licen[sc]e
3|0.97|epl-2.0|epl|(?:licen[sc]e(?: identifier)?|licen[sc]ed under(?: the)?) epl 2 0
3|0.97|epl-2.0|epl|epl 2 0 licen[sc]e
3|0.98|edl-1.0|eclipse|eclipse distribution licen[sc]e (?:version |v )?1 0
3|0.99|cddl-1.1|common|common development and distribution licen[sc]e (?:version |v )?1 1
3|0.99|cddl-1.0|common|common development and distribution licen[sc]e (?:version |v )?1 0
2|0.95|cddl|common|common development and distribution licen[sc]e
2|0.85|cddl|cddl|cddl
3|0.98|cpl-1.0|common|common public licen[sc]e (?:version |v )?1 0
3|0.98|cpal-1.0|common|common public attribution licen[sc]e
3|0.99|eupl-1.2|union|european union public licen[sc]e (?:version |v )?1 2
3|0.99|eupl-1.1|union|european union public licen[sc]e (?:version |v )?1 1
2|0.95|eupl|union|european union public licen[sc]e
2|0.9|eupl|eupl|eupl
3|0.98|artistic-2.0|artistic|artistic licen[sc]e (?:version |v )?2 0
3|0.98|artistic-1.0|artistic|artistic licen[sc]e (?:version |v )?1 0
2|0.95|artistic|artistic|artistic licen[sc]e
2|0.9|perl|perl|same terms as perl itself
2|0.95|python-2.0|python|python (?:software foundation )?licen[sc]e(?: version 2)?
2|0.9|psf-2.0|psf|psf licen[sc]e
2|0.95|ruby|ruby|ruby licen[sc]e
2|0.95|php-3.01|php|php licen[sc]e (?:version |v )?3 01
2|0.9|php|php|php licen[sc]e
2|0.95|openssl|openssl|openssl licen[sc]e
2|0.95|ssleay|ssleay|ssleay licen[sc]e
2|0.95|ncsa|ncsa|university of illinois ncsa open source licen[sc]e
2|0.9|ncsa|ncsa|ncsa (?:open source )?licen[sc]e
2|0.95|ms-pl|microsoft|microsoft public licen[sc]e
2|0.95|ms-rl|microsoft|microsoft reciprocal licen[sc]e
2|0.95|afl-3.0|academic|academic free licen[sc]e (?:version |v )?3 0
2|0.9|afl|academic|academic free licen[sc]e
2|0.95|osl-3.0|open|open software licen[sc]e (?:version |v )?3 0
2|0.9|osl|open|open software licen[sc]e
2|0.95|ecl-2.0|educational|educational community licen[sc]e (?:version |v )?2 0
2|0.9|ecl|educational|educational community licen[sc]e
2|0.95|upl-1.0|universal|universal permissive licen[sc]e
2|0.95|postgresql|postgresql|postgresql licen[sc]e
2|0.95|vim|vim|vim licen[sc]e
2|0.95|curl|curl|curl licen[sc]e
2|0.95|ofl-1.1|sil|sil open font licen[sc]e (?:version |v )?1 1
2|0.9|ofl|font|open font licen[sc]e
2|0.9|beerware|beerware|beerware licen[sc]e
2|0.85|beerware|beer|beer ware licen[sc]e
2|0.95|cecill-2.1|cecill|cecill (?:version |v )?2 1
2|0.9|cecill|cecill|cecill(?: b| c)?
2|0.9|qpl|q|q public licen[sc]e
2|0.9|ipl-1.0|ibm|ibm public licen[sc]e
2|0.9|apsl-2.0|apple|apple public source licen[sc]e
2|0.9|nasa|nasa|nasa open source agreement
2|0.9|sleepycat|sleepycat|sleepycat licen[sc]e
2|0.9|zpl-2.1|zope|zope public licen[sc]e
2|0.9|w3c|w3c|w3c software (?:notice and )?licen[sc]e
2|0.9|unicode|unicode|unicode licen[sc]e agreement
2|0.9|jpeg|jpeg|independent jpeg group licen[sc]e
2|0.9|blueoak|blue|blue oak model licen[sc]e
2|0.95|mulan-psl-2.0|mulan|mulan permissive software licen[sc]e
2|0.95|sspl-1.0|server|server side public licen[sc]e
2|0.9|sspl|sspl|sspl
2|0.95|busl-1.1|business|business source licen[sc]e (?:version |v )?1 1
2|0.9|busl|business|business source licen[sc]e
2|0.95|elastic-2.0|elastic|elastic licen[sc]e (?:version |v )?2(?: 0)?
2|0.9|elastic|elastic|elastic licen[sc]e
2|0.9|commons-clause|clause|commons clause
2|0.9|polyform|polyform|polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e
2|0.9|confluent|confluent|confluent community licen[sc]e
2|0.9|rail|rail|(?:open )?rail(?: m| s)? licen[sc]e
2|0.9|rail|openrail|(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?
2|0.9|llama|llama|llama (?:2 |3 )?community licen[sc]e(?: agreement)?
3|0.99|cc-by-nc-nd-4.0|nd|cc by nc nd 4 0
3|0.99|cc-by-nc-nd-3.0|nd|cc by nc nd 3 0
3|0.99|cc-by-nc-nd-2.0|nd|cc by nc nd 2 [05]
3|0.99|cc-by-nc-sa-4.0|sa|cc by nc sa 4 0
3|0.99|cc-by-nc-sa-3.0|sa|cc by nc sa 3 0
3|0.99|cc-by-nc-sa-2.0|sa|cc by nc sa 2 [05]
3|0.99|cc-by-nc-4.0|nc|cc by nc 4 0
3|0.99|cc-by-nc-3.0|nc|cc by nc 3 0
3|0.99|cc-by-nc-2.0|nc|cc by nc 2 [05]
3|0.99|cc-by-nd-4.0|nd|cc by nd 4 0
3|0.99|cc-by-nd-3.0|nd|cc by nd 3 0
3|0.99|cc-by-sa-4.0|sa|cc by sa 4 0
3|0.99|cc-by-sa-3.0|sa|cc by sa 3 0
3|0.99|cc-by-sa-2.0|sa|cc by sa 2 [05]
3|0.99|cc-by-4.0|cc|cc by 4 0
3|0.99|cc-by-3.0|cc|cc by 3 0
3|0.99|cc-by-2.0|cc|cc by 2 [05]
2|0.9|cc-by-nc-nd|nd|cc by nc nd
2|0.9|cc-by-nc-sa|sa|cc by nc sa
2|0.9|cc-by-nc|nc|cc by nc
2|0.9|cc-by-nd|nd|cc by nd
2|0.9|cc-by-sa|sa|cc by sa
2|0.8|cc-by|cc|cc by
3|0.98|cc-by-nc-nd|commons|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
3|0.98|cc-by-nc-sa|commons|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
3|0.98|cc-by-nc|commons|creative commons attribution non ?commercial(?: [1-4] [05])?
3|0.98|cc-by-nd|commons|creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?
3|0.98|cc-by-sa|commons|creative commons attribution share ?alike(?: [1-4] [05])?
3|0.97|cc-by|commons|creative commons attribution(?: [1-4] [05])?
3|0.97|cc-by-nc-nd|creativecommons|creativecommons org licenses by nc nd(?: [1-4] [05])?
3|0.97|cc-by-nc-sa|creativecommons|creativecommons org licenses by nc sa(?: [1-4] [05])?
3|0.97|cc-by-nc|creativecommons|creativecommons org licenses by nc(?: [1-4] [05])?
3|0.97|cc-by-nd|creativecommons|creativecommons org licenses by nd(?: [1-4] [05])?
3|0.97|cc-by-sa|creativecommons|creativecommons org licenses by sa(?: [1-4] [05])?
3|0.97|cc-by|creativecommons|creativecommons org licenses by(?: [1-4] [05])?
3|0.97|cc0-1.0|creativecommons|creativecommons org publicdomain zero 1 0
3|0.98|cc0-1.0|cc0|cc0(?: 1 0)?
3|0.98|cc0-1.0|zero|cc zero
3|0.98|cc0-1.0|universal|creative commons zero (?:v1 0 )?universal
3|0.95|pdm-1.0|mark|(?:creative commons )?public domain mark(?: 1 0)?
2|0.85|cc|commons|creative commons licen[sc]e
1|0.8|cc|commons|some rights reserved creative commons
3|0.98|odbl-1.0|database|open (?:data commons open )?database licen[sc]e(?: odbl)?
2|0.9|odbl-1.0|odbl|odbl
3|0.98|odc-by-1.0|commons|open data commons attribution licen[sc]e
3|0.98|pddl-1.0|commons|open data commons public domain dedication(?: and licen[sc]e)?
2|0.9|pddl-1.0|pddl|pddl
3|0.97|ogl-uk-3.0|government|open government licen[sc]e (?:version |v )?3 0
2|0.95|ogl|government|open government licen[sc]e
2|0.9|etalab-2.0|ouverte|licence ouverte(?: open licence)?
2|0.9|dl-de-by-2.0|datenlizenz|datenlizenz deutschland namensnennung
2|0.9|cdla-permissive|community|community data licen[sc]e agreement permissive
2|0.9|cdla-sharing|community|community data licen[sc]e agreement sharing
2|0.9|public-domain|domain|(?:released|dedicated|placed) (?:in|into|to) the public domain
1|0.7|public-domain|domain|(?:is|are) in the public domain
2|0.9|project-gutenberg|gutenberg|project gutenberg licen[sc]e
1|0.6|spdx|spdx|spdx licen[sc]e identifier
0|0.5|proprietary|reserved|all rights reserved
0|0.5|proprietary|proprietary|proprietary and confidential
0|0.5|proprietary|unauthorized|unauthorized (?:copying|reproduction|distribution) (?:of this file )?(?:is )?(?:strictly )?prohibited
0|0.4|copyright|copyright|copyright c? ?(?:19|20)\d\d
0|0.4|copyright|droits|tous droits réservés
0|0.4|copyright|rechte|alle rechte vorbehalten
0|0.4|copyright|derechos|todos los derechos reservados
"""


def rules() -> list[tuple[int, float, str, str, str]]:
    """(priority, confidence, label, keyword, signature) in the order written."""
    out = []
    for line in TEXT.strip().splitlines():
        priority, confidence, label, keyword, signature = line.split("|", 4)
        out.append((int(priority), float(confidence), label, keyword, signature))
    return out
