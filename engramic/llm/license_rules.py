"""The rules of the license scan, written by hand, section by section in falling priority.

A rule is (label, keyword, pattern). In a pattern a space stands for any white space, ``license`` for
both spellings, and ``~2.0`` for a version number with or without "v", "version" or a comma before it
(``.0`` may be missing at its end). The keyword is one word, or a part of one, that every match
contains, so white space in a text cannot hide it.
"""

from __future__ import annotations

#: (section, priority, confidence)
SECTIONS = {"tag": (50, 1.0), "clause": (40, 0.9), "versioned": (30, 0.85), "address": (28, 0.9), "notice": (25, 0.8), "name": (15, 0.6), "hint": (10, 0.5)}

#: The label of a tag is the identifier it names.
TAG = ("spdx", r"spdx-license-identifier:\s*\(?(?P<id>[a-z0-9][a-z0-9.+-]*[a-z0-9+])")

CLAUSES = (
    ("mit", "hereby", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit", "sublicen", r"rights to use,? copy,? modify,? merge,? publish,? distribute,? sublicense,? and/or sell copies"),
    ("mit", "permission", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("x11", "consortium", r"the name of the x consortium shall not be used in advertising"),
    ("isc", "permission", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee"),
    ("hpnd", "permission", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose"),
    ("bsd-2-clause", "redistribution", r"redistributions? (?:of source code|in binary form) must (?:retain|reproduce) the above copyright"),
    ("bsd-2-clause", "redistribution", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", r"may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", r"all advertising materials? mentioning features or use of this software"),
    ("bsd-patent", "patent", r"redistributions? of the software with an additional grant of patent rights"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("libpng", "png", r"the png reference library is supplied|libpng versions? [\d.]+"),
    ("boost-1.0", "machine-executable", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "changing", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed"),
    ("gpl", "foundation", r"(?:as )?published by the free software foundation"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu (?:general|lesser|library|affero)"),
    ("gpl", "received", r"you should have received a copy of the gnu (?:general|lesser|library|affero) (?:general )?public license"),
    ("gpl-or-later", "later", r"(?:either )?version \d(?:\.\d)?(?: of the license)?,? or \(?at your option\)? any later version"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free,? copyleft license"),
    ("gpl-3.0", "conveying", r"conveying modified source versions"),
    ("lgpl", "combined", r"convey a combined work under terms of your choice"),
    ("agpl-3.0", "remote", r"remote network interaction; use with the gnu general public license"),
    ("gfdl", "invariant", r"with no invariant sections,? (?:with )?no front-cover texts"),
    ("classpath-exception", "linking", r"linking this (?:library|software) statically or dynamically with other modules is making a combined work"),
    ("gcc-exception", "runtime", r"gcc runtime library exception"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "grant", r"grant of patent license\. subject to the terms and conditions of this license"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl-1.1", "initial", r"the initial developer of the original code is"),
    ("epl-2.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("artistic", "package", r"the copyright holder states the conditions under which a package may be copied"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", "eric", r"this product includes cryptographic software written by eric young"),
    ("postgresql", "california", r"in no event shall the university of california be liable to any party"),
    ("python-2.0", "psf", r"psf is making python available to licensee"),
    ("php", "php", r"this product includes php software,? freely available from"),
    ("ofl-1.1", "reserved", r"reserved font name"),
    ("ofl-1.1", "goals", r"the goals of the open font license \(ofl\)"),
    ("unicode", "unicode", r"unicode,? inc\. license agreement|unicode data files and software"),
    ("cc", "commons", r"creative commons corporation is not a law firm"),
    ("cc0-1.0", "dedication", r"public domain dedication"),
    ("cc0-1.0", "waive", r"overtly, fully, permanently, irrevocably and unconditionally waives?"),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", "disclaim", r"the author(?:s)? disclaims? copyright to this source code"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("json", "evil", r"the software shall be used for good,? not evil"),
    ("curl", "daniel", r"copyright \(c\) [\d ,-]+ daniel stenberg"),
    ("sspl-1.0", "functionality", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "change", r"change date,? or the fourth anniversary of the first publicly available distribution"),
    ("commons-clause", "sell", r"the license does not grant to you,? the right to sell the software"),
    ("commons-clause", "commons", r"commons clause license condition"),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("openrail", "use-based", r"use-based restrictions"),
    ("noncommercial", "commercial", r"for non-?commercial (?:use|purposes) only"),
    ("academic-use", "only", r"for (?:academic|research) (?:and (?:academic|research) )?(?:use|purposes) only"),
    ("evaluation", "evaluation", r"for evaluation purposes only"),
    ("proprietary", "confidential", r"(?:strictly )?confidential and proprietary"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) (?:of this (?:file|software|document)|or (?:copying|distribution)|is (?:strictly )?prohibited)"),
    ("proprietary", "trade", r"(?:contains?|constitutes?) (?:the )?(?:valuable )?trade secrets?"),
    ("proprietary", "without", r"may not be (?:copied|disclosed|reproduced)(?:,? (?:copied|disclosed|reproduced|or|in whole or in part))* without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
)

VERSIONED = (
    ("gpl-1.0", "general", r"gnu general public license~1.0"),
    ("gpl-2.0", "general", r"gnu general public license~2.0"),
    ("gpl-3.0", "general", r"gnu general public license~3.0"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl~1.0"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl~2.0"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl~3.0"),
    ("lgpl-2.0", "library", r"gnu library general public license~2.0"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license~2.1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license~3.0"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl~2.0"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl~2.1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl~3.0"),
    ("agpl-1.0", "affero", r"affero general public license~1.0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license~3.0"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl~3.0"),
    ("gfdl-1.1", "documentation", r"gnu free documentation license~1.1"),
    ("gfdl-1.2", "documentation", r"gnu free documentation license~1.2"),
    ("gfdl-1.3", "documentation", r"gnu free documentation license~1.3"),
    ("apache-1.0", "apache", r"apache (?:software )?license~1.0"),
    ("apache-1.1", "apache", r"apache (?:software )?license~1.1"),
    ("apache-2.0", "apache", r"apache (?:software )?license~2.0"),
    ("apache-2.0", "apache", r"apache~2.0"),
    ("apache-2.0", "asl", r"asl~2.0"),
    ("mpl-1.0", "mozilla", r"mozilla public license~1.0"),
    ("mpl-1.1", "mozilla", r"mozilla public license~1.1"),
    ("mpl-2.0", "mozilla", r"mozilla public license~2.0"),
    ("mpl-1.1", "mpl", r"mpl~1.1"),
    ("mpl-2.0", "mpl", r"mpl~2.0"),
    ("epl-1.0", "eclipse", r"eclipse public license~1.0"),
    ("epl-2.0", "eclipse", r"eclipse public license~2.0"),
    ("epl-1.0", "epl", r"epl~1.0"),
    ("epl-2.0", "epl", r"epl~2.0"),
    ("edl-1.0", "eclipse", r"eclipse distribution license~1.0"),
    ("cpl-1.0", "common", r"common public license~1.0"),
    ("ipl-1.0", "ibm", r"ibm public license~1.0"),
    ("cddl-1.0", "distribution", r"common development and distribution license~1.0"),
    ("cddl-1.1", "distribution", r"common development and distribution license~1.1"),
    ("cddl-1.0", "cddl", r"cddl~1.0"),
    ("cddl-1.1", "cddl", r"cddl~1.1"),
    ("cpal-1.0", "attribution", r"common public attribution license~1.0"),
    ("eupl-1.1", "european", r"european union public license~1.1"),
    ("eupl-1.2", "european", r"european union public license~1.2"),
    ("eupl-1.1", "eupl", r"eupl~1.1"),
    ("eupl-1.2", "eupl", r"eupl~1.2"),
    ("osl-1.0", "open", r"open software license~1.0"),
    ("osl-2.1", "open", r"open software license~2.1"),
    ("osl-3.0", "open", r"open software license~3.0"),
    ("afl-2.0", "academic", r"academic free license~2.0"),
    ("afl-2.1", "academic", r"academic free license~2.1"),
    ("afl-3.0", "academic", r"academic free license~3.0"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic license~1.0"),
    ("artistic-2.0", "artistic", r"(?:perl )?artistic license~2.0"),
    ("boost-1.0", "boost", r"boost software license~1.0"),
    ("boost-1.0", "bsl-1", r"bsl-1\.0"),
    ("lppl-1.2", "latex", r"latex project public license~1.2"),
    ("lppl-1.3", "latex", r"latex project public license~1.3"),
    ("ofl-1.0", "sil", r"sil open font license~1.0"),
    ("ofl-1.1", "sil", r"sil open font license~1.1"),
    ("ofl-1.1", "ofl", r"ofl~1.1"),
    ("php-3.0", "php", r"php license~3.0"),
    ("php-3.01", "php", r"php license~3.01"),
    ("python-2.0", "python", r"python (?:software foundation )?license~2.0"),
    ("zpl-2.0", "zope", r"zope public license~2.0"),
    ("zpl-2.1", "zope", r"zope public license~2.1"),
    ("qpl-1.0", "public", r"q public license~1.0"),
    ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?license"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license~1.0"),
    ("odbl-1.0", "odbl", r"odbl~1.0"),
    ("odc-by-1.0", "commons", r"open data commons attribution license~1.0"),
    ("pddl-1.0", "pddl", r"pddl~1.0"),
    ("sspl-1.0", "server", r"server side public license~1.0"),
    ("sspl-1.0", "sspl", r"sspl~1.0"),
    ("busl-1.1", "business", r"business source license~1.1"),
    ("busl-1.1", "busl", r"busl~1.1"),
    ("elastic-1.0", "elastic", r"elastic license~1.0"),
    ("elastic-2.0", "elastic", r"elastic license~2.0"),
    ("upl-1.0", "permissive", r"universal permissive license~1.0"),
    ("upl-1.0", "upl", r"upl~1.0"),
    ("cecill-2.0", "cecill", r"cecill~2.0"),
    ("cecill-2.1", "cecill", r"cecill~2.1"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software license)~2.0"),
    ("wtfpl-2.0", "wtfpl", r"wtfpl~2.0"),
    ("cc0-1.0", "cc0", r"cc0~1.0(?: universal)?"),
    ("cc-by-1.0", "cc", r"cc[\s-]+by~1.0"),
    ("cc-by-2.0", "cc", r"cc[\s-]+by~2.0"),
    ("cc-by-2.5", "cc", r"cc[\s-]+by~2.5"),
    ("cc-by-3.0", "cc", r"cc[\s-]+by~3.0"),
    ("cc-by-4.0", "cc", r"cc[\s-]+by~4.0"),
    ("cc-by-sa-1.0", "cc", r"cc[\s-]+by[\s-]+sa~1.0"),
    ("cc-by-sa-2.0", "cc", r"cc[\s-]+by[\s-]+sa~2.0"),
    ("cc-by-sa-2.5", "cc", r"cc[\s-]+by[\s-]+sa~2.5"),
    ("cc-by-sa-3.0", "cc", r"cc[\s-]+by[\s-]+sa~3.0"),
    ("cc-by-sa-4.0", "cc", r"cc[\s-]+by[\s-]+sa~4.0"),
    ("cc-by-nd-2.0", "cc", r"cc[\s-]+by[\s-]+nd~2.0"),
    ("cc-by-nd-3.0", "cc", r"cc[\s-]+by[\s-]+nd~3.0"),
    ("cc-by-nd-4.0", "cc", r"cc[\s-]+by[\s-]+nd~4.0"),
    ("cc-by-nc-2.0", "cc", r"cc[\s-]+by[\s-]+nc~2.0"),
    ("cc-by-nc-2.5", "cc", r"cc[\s-]+by[\s-]+nc~2.5"),
    ("cc-by-nc-3.0", "cc", r"cc[\s-]+by[\s-]+nc~3.0"),
    ("cc-by-nc-4.0", "cc", r"cc[\s-]+by[\s-]+nc~4.0"),
    ("cc-by-nc-sa-2.0", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+sa~2.0"),
    ("cc-by-nc-sa-3.0", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+sa~3.0"),
    ("cc-by-nc-sa-4.0", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+sa~4.0"),
    ("cc-by-nc-nd-3.0", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+nd~3.0"),
    ("cc-by-nc-nd-4.0", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+nd~4.0"),
    ("cc-by-3.0", "creative", r"creative commons attribution(?: license)?~3.0"),
    ("cc-by-4.0", "creative", r"creative commons attribution(?: license)?~4.0"),
    ("cc-by-sa-3.0", "creative", r"creative commons attribution[\s-]+share[\s-]*alike(?: license)?~3.0"),
    ("cc-by-sa-4.0", "creative", r"creative commons attribution[\s-]+share[\s-]*alike(?: license)?~4.0"),
    ("cc-by-nc-3.0", "creative", r"creative commons attribution[\s-]+non[\s-]*commercial(?: license)?~3.0"),
    ("cc-by-nc-4.0", "creative", r"creative commons attribution[\s-]+non[\s-]*commercial(?: license)?~4.0"),
    ("cc-by-nc-sa-4.0", "creative", r"creative commons attribution[\s-]+non[\s-]*commercial[\s-]+share[\s-]*alike(?: license)?~4.0"),
    ("cc-by-nc-nd-4.0", "creative", r"creative commons attribution[\s-]+non[\s-]*commercial[\s-]+no[\s-]*deriv(?:ative)?s?(?: license)?~4.0"),
)

ADDRESSES = (
    ("gpl-2.0", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gnu.org", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.1", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "gnu.org", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "gnu.org", r"gnu\.org/licenses/agpl-3\.0"),
    ("gfdl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("gpl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt)"),
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache.org", r"apache\.org/licenses/license-1\.1"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/(?:mpl-)?1\.1"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("epl-1.0", "eclipse.org", r"eclipse\.org/legal/epl-v10"),
    ("mit", "opensource.org", r"opensource\.org/licenses?/mit"),
    ("isc", "opensource.org", r"opensource\.org/licenses?/isc"),
    ("zlib", "opensource.org", r"opensource\.org/licenses?/zlib"),
    ("bsd-2-clause", "opensource.org", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "opensource.org", r"opensource\.org/licenses?/bsd-3-clause"),
    ("boost-1.0", "boost.org", r"boost\.org/license_1_0"),
    ("unlicense", "unlicen", r"unlicense\.org"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("ofl-1.1", "sil.org", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "opendatacommons", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "opendatacommons", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", "creativecommons", r"creativecommons\.org/publicdomain/zero"),
    ("public-domain", "creativecommons", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by-4.0", "creativecommons", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-3.0", "creativecommons", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-sa-4.0", "creativecommons", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-sa-3.0", "creativecommons", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-nc-4.0", "creativecommons", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nc-sa-4.0", "creativecommons", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-nd-4.0", "creativecommons", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("cc", "creativecommons", r"creativecommons\.org/licenses"),
)

NOTICES = (
    ("gpl", "general", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?gnu general public license"),
    ("gpl", "gpl", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"),
    ("lgpl", "lgpl", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl"),
    ("apache", "apache", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the )?)?apache(?: (?:software )?license)?"),
    ("mit", "mit", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the )?)?mit(?: license)?"),
    ("bsd", "bsd", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the |a )?)?bsd(?:-style)?(?: license)?"),
    ("mpl", "mpl", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the )?)?mpl"),
    ("isc", "isc", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the )?)?isc(?: license)?"),
    ("zlib", "zlib", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:terms of (?:the )?)?zlib(?: license)?"),
    ("cc", "creative", r"(?:licensed|released|distributed|available|covered) under (?:a |the )?(?:terms of (?:the |a )?)?creative commons"),
    ("perl", "perl", r"under the same terms as perl(?: itself)?"),
    ("dual", "dual", r"dual[\s-]licensed under"),
    ("see-license", "licen", r"see (?:the )?(?:file )?license(?:\.(?:txt|md))? (?:file )?for (?:details|more|the full)"),
    ("see-copying", "copying", r"see (?:the )?(?:file )?copying(?:\.(?:txt|lib|lesser))? (?:file )?for (?:details|more|the full)"),
)

NAMES = (
    ("gpl", "general", r"gnu general public license"),
    ("gpl", "gnu", r"gnu gpl"),
    ("gpl", "gpl", r"gpl-compatible|gpl'd|gpled"),
    ("lgpl", "general", r"gnu (?:lesser|library) general public license"),
    ("lgpl", "lgpl", r"lgpl"),
    ("agpl", "affero", r"gnu affero general public license"),
    ("agpl", "agpl", r"agpl"),
    ("gfdl", "documentation", r"gnu free documentation license"),
    ("gfdl", "gfdl", r"gfdl"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("mit", "mit", r"(?:the )?mit license"),
    ("mit", "mit", r"mit/x11"),
    ("mit", "expat", r"expat license"),
    ("x11", "x11", r"x11 license"),
    ("bsd", "bsd", r"bsd license"),
    ("bsd", "bsd", r"bsd-style license"),
    ("bsd", "berkeley", r"berkeley software distribution license"),
    ("bsd-0-clause", "0bsd", r"0bsd"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd license|bsd 2-clause|2-clause bsd|two-clause bsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3-clause|3-clause bsd|three-clause bsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd license"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4-clause|4-clause bsd|four-clause bsd)(?: license)?"),
    ("isc", "isc", r"isc license"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("npl", "netscape", r"netscape public license"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cpl", "common", r"common public license"),
    ("cddl", "distribution", r"common development and distribution license"),
    ("cddl", "cddl", r"cddl"),
    ("eupl", "european", r"european union public license"),
    ("eupl", "eupl", r"eupl"),
    ("osl", "open", r"open software license"),
    ("afl", "academic", r"academic free license"),
    ("ecl", "educational", r"educational community license"),
    ("artistic", "artistic", r"(?:perl )?artistic license"),
    ("boost", "boost", r"boost (?:software )?license"),
    ("lppl", "latex", r"latex project public license"),
    ("lppl", "lppl", r"lppl"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("ms-pl", "ms-pl", r"ms-pl"),
    ("ms-rl", "ms-rl", r"ms-rl"),
    ("ofl", "font", r"(?:sil )?open font license"),
    ("php", "php", r"php license"),
    ("python", "python", r"python software foundation license"),
    ("python", "psf", r"psf license"),
    ("ruby", "ruby", r"ruby license"),
    ("zlib", "zlib", r"zlib(?:/libpng)? license"),
    ("libpng", "libpng", r"libpng license"),
    ("openssl", "openssl", r"openssl license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("zpl", "zope", r"zope public license"),
    ("qpl", "public", r"q public license"),
    ("intel", "intel", r"intel (?:simplified software|open source) license"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source license"),
    ("sleepycat", "sleepycat", r"sleepycat license"),
    ("cecill", "cecill", r"cecill(?:-[abc])?"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software license)"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "want", r"do what the f\w* you want to public license"),
    ("unlicense", "unlicen", r"(?:the )?unlicense"),
    ("beerware", "beer", r"beer-?ware license"),
    ("odbl", "database", r"open (?:data commons open )?database license"),
    ("odbl", "odbl", r"odbl"),
    ("odc-by", "commons", r"open data commons attribution license"),
    ("pddl", "pddl", r"pddl"),
    ("sspl", "server", r"server side public license"),
    ("busl", "business", r"business source license"),
    ("elastic", "elastic", r"elastic license"),
    ("commons-clause", "clause", r"commons clause"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial)(?: license)?"),
    ("upl", "permissive", r"universal permissive license"),
    ("openrail", "rail", r"(?:creativeml )?open\s*rail(?:\+\+)?(?:-[ms])?"),
    ("llama", "llama", r"llama \d(?:\.\d)? community license"),
    ("cc0-1.0", "cc0", r"cc0"),
    ("cc-by", "cc", r"cc[\s-]+by"),
    ("cc-by-sa", "cc", r"cc[\s-]+by[\s-]+sa"),
    ("cc-by-nd", "cc", r"cc[\s-]+by[\s-]+nd"),
    ("cc-by-nc", "cc", r"cc[\s-]+by[\s-]+nc"),
    ("cc-by-nc-sa", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+sa"),
    ("cc-by-nc-nd", "cc", r"cc[\s-]+by[\s-]+nc[\s-]+nd"),
    ("cc-by", "creative", r"creative commons attribution"),
    ("cc-by-sa", "creative", r"creative commons attribution[\s-]+share[\s-]*alike"),
    ("cc-by-nd", "creative", r"creative commons attribution[\s-]+no[\s-]*deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc", "creative", r"creative commons attribution[\s-]+non[\s-]*commercial"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution[\s-]+non[\s-]*commercial[\s-]+share[\s-]*alike"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution[\s-]+non[\s-]*commercial[\s-]+no[\s-]*deriv(?:ative)?s?(?: works)?"),
    ("cc", "creative", r"creative commons license"),
)

HINTS = (
    ("proprietary", "reserved", r"all rights reserved"),
    ("copyright-notice", "copyright", r"copyright (?:\(c\)\s*|©\s*)?(?:\d{4}(?:\s*[-–,]\s*\d{4})*)"),
    ("no-warranty", "warrant", r"without warrant(?:y|ies)(?: or conditions)? of any kind"),
    ("no-warranty", "warranty", r"without any warranty;? without even the implied warranty of"),
    ("no-warranty", "warrant", r"provided \"?as is\"?,? without warrant(?:y|ies)"),
    ("no-liability", "liable", r"in no event shall the (?:authors?|copyright (?:holders?|owners?))(?: or (?:copyright holders|contributors))? be liable"),
    ("permission-required", "permission", r"(?:reprinted|reproduced|used) (?:by|with) (?:the )?(?:kind )?permission of"),
    ("terms-of-use", "terms", r"by (?:using|accessing) this (?:site|website|software|service),? you agree to (?:the|our|these) terms"),
)
