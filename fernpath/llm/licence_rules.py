"""The signature rules of the licence scan, written by hand.

A rule has a label, its keywords (one of them stands in every match, white space taken as one space), a pattern over lower-case text, and a sample that it must find.
In patterns a space stands for any white space, {v} for what may stand between a name and its version, {e} for the end of a number.
Rules of TEXTS beat those of TAGS, these those of VERSIONS, and these those of NAMES; within a list the earlier rule beats the later.
"""

from __future__ import annotations

# Sentences of licence texts and notices.
TEXTS = [
    ("mit", "permission is", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "above copyright", r"the above copyright notice and this permission notice(?: \(including the next paragraph\))? shall be included in all copies", "The above copyright notice and this permission notice shall be included in all copies"),
    ("mit-0", "without restriction", r"to deal in the software without restriction, including .{1,140} to permit persons to whom the software is furnished to do so\.\s*the software is provided", "to deal in the Software without restriction, including use, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED"),
    ("isc", "permission to use", r"permission to use, copy, modify,(?: and(?:/or)?)? distribute this software for any purpose with or without fee is hereby granted, provided", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided"),
    ("0bsd", "permission to use", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("bsd-3-clause", "neither the name", r"neither the names? of .{1,120}? (?:may|shall) be used to endorse or promote products", "Neither the name of the author nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising", r"all advertising materials mentioning features or use of this software must display", "All advertising materials mentioning features or use of this software must display"),
    ("bsd", "redistribution and", r"redistribution and use in source and binary forms, with or without modification", "Redistribution and use in source and binary forms, with or without modification"),
    ("bsd", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright", "Redistributions of source code must retain the above copyright"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party's patent rights are granted by this license", "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE"),
    ("apache-2.0", "apache", r"licensed under the apache license, version 2\.0 \(the [\"']?license[\"']?\)", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-2.0", "apache.org", r"(?:https?://)?(?:www\.)?apache\.org/licenses/license-2\.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-1.1", "apache software", r"this product includes software developed by the apache software foundation", "This product includes software developed by the Apache Software Foundation"),
    ("gpl-2.0-or-later", "free software", r"under the terms of the gnu general public license as published by the free software foundation[;,] either version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("gpl-3.0-or-later", "free software", r"under the terms of the gnu general public license as published by the free software foundation[;,] either version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("gpl-2.0", "free software", r"under the terms of (?:the )?(?:version 2 of the )?gnu general public license(?: version 2)? as published by the free software foundation", "under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-1.0-or-later", "free software", r"gnu general public license as published by the free software foundation[;,] either version 1", "GNU General Public License as published by the Free Software Foundation; either version 1"),
    ("lgpl-2.1-or-later", "lesser general", r"gnu lesser general public license as published by the free software foundation[;,] either version 2\.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("lgpl-3.0-or-later", "lesser general", r"gnu lesser general public license as published by the free software foundation[;,] either version 3", "GNU Lesser General Public License as published by the Free Software Foundation, either version 3"),
    ("lgpl-2.0-or-later", "library general", r"gnu library general public license as published by the free software foundation[;,] either version 2", "GNU Library General Public License as published by the Free Software Foundation; either version 2"),
    ("agpl-3.0-or-later", "affero general", r"gnu affero general public license as published by the free software foundation[;,] either version 3", "GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("gpl-3.0", "gnu.org", r"gnu\.org/licenses/gpl-3\.0", "https://www.gnu.org/licenses/gpl-3.0.html"),
    ("gpl-2.0", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", "https://www.gnu.org/licenses/old-licenses/gpl-2.0.html"),
    ("lgpl-3.0", "gnu.org", r"gnu\.org/licenses/lgpl-3\.0", "https://www.gnu.org/licenses/lgpl-3.0.html"),
    ("lgpl-2.1", "gnu.org", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", "https://www.gnu.org/licenses/old-licenses/lgpl-2.1.html"),
    ("agpl-3.0", "gnu.org", r"gnu\.org/licenses/agpl-3\.0", "https://www.gnu.org/licenses/agpl-3.0.html"),
    ("gfdl", "gnu.org", r"gnu\.org/(?:licenses|copyleft)/fdl", "https://www.gnu.org/licenses/fdl.html"),
    ("gfdl", "free documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("mpl-2.0", "mozilla public", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/mpl/2\.0", "http://mozilla.org/MPL/2.0/"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public license version 1\.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense.org", r"unlicense\.org", "http://unlicense.org"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", "The origin of this software must not be misrepresented"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", "Altered source versions must be plainly marked as such"),
    ("bsl-1.0", "permission is", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("bsl-1.0", "boost.org", r"boost\.org/license_1_0", "http://www.boost.org/LICENSE_1_0.txt"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[sc]e", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("artistic-2.0", "artistic", r"the artistic license 2\.0", "The Artistic License 2.0"),
    ("postgresql", "without a written", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("ofl-1.1", "sil open font", r"this font software is licensed under the sil open font license, version 1\.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("ofl", "scripts.sil.org", r"scripts\.sil\.org/ofl", "http://scripts.sil.org/OFL"),
    ("cc0-1.0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero/1\.0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("cc-pddc", "publicdomain/mark", r"creativecommons\.org/publicdomain/mark/1\.0", "https://creativecommons.org/publicdomain/mark/1.0/"),
    ("cc-by-nc-nd-4.0", "licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/4\.0", "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("cc-by-nc-nd-3.0", "licenses/by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/3\.0", "https://creativecommons.org/licenses/by-nc-nd/3.0/"),
    ("cc-by-nc-sa-4.0", "licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/4\.0", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("cc-by-nc-sa-3.0", "licenses/by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/3\.0", "https://creativecommons.org/licenses/by-nc-sa/3.0/"),
    ("cc-by-nc-4.0", "licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/4\.0", "https://creativecommons.org/licenses/by-nc/4.0/"),
    ("cc-by-nc-3.0", "licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/3\.0", "https://creativecommons.org/licenses/by-nc/3.0/"),
    ("cc-by-nd-4.0", "licenses/by-nd/", r"creativecommons\.org/licenses/by-nd/4\.0", "https://creativecommons.org/licenses/by-nd/4.0/"),
    ("cc-by-nd-3.0", "licenses/by-nd/", r"creativecommons\.org/licenses/by-nd/3\.0", "https://creativecommons.org/licenses/by-nd/3.0/"),
    ("cc-by-sa-4.0", "licenses/by-sa/", r"creativecommons\.org/licenses/by-sa/4\.0", "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc-by-sa-3.0", "licenses/by-sa/", r"creativecommons\.org/licenses/by-sa/3\.0", "https://creativecommons.org/licenses/by-sa/3.0/"),
    ("cc-by-4.0", "licenses/by/", r"creativecommons\.org/licenses/by/4\.0", "https://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-3.0", "licenses/by/", r"creativecommons\.org/licenses/by/3\.0", "https://creativecommons.org/licenses/by/3.0/"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/(?:legal|org/documents)/epl-2\.0", "https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-1.0", "eclipse.org", r"eclipse\.org/(?:legal|org/documents)/epl-v10", "http://www.eclipse.org/legal/epl-v10.html"),
    ("edl-1.0", "eclipse.org", r"eclipse\.org/org/documents/edl-v10", "http://www.eclipse.org/org/documents/edl-v10.php"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("curl", "permission to use", r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement of third party rights", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS"),
    ("json", "good, not evil", r"the software shall be used for good, not evil", "The Software shall be used for Good, not Evil"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", "you can buy me a beer in return"),
    ("ms-pl", "accept this license", r"if you use the software, you accept this license", "If you use the software, you accept this license"),
    ("unicode", "data files", r"to deal in the data files or software without restriction", "to deal in the Data Files or Software without restriction"),
    ("proprietary", "proprietary", r"proprietary and confidential", "Proprietary and confidential"),
    ("proprietary", "unauthorized|unauthorised", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)", "Unauthorized copying of this file"),
    ("proprietary", "nondisclosure|non-disclosure", r"(?:subject to|under) (?:a|the|the terms of a) (?:non-?disclosure|nda) agreement", "subject to a non-disclosure agreement"),
    ("proprietary", "trade secret", r"(?:contains|constitutes|protected as) (?:confidential information and )?trade secrets?", "contains trade secrets"),
    ("non-commercial", "commercial", r"(?:for|licensed for|free for) (?:personal,? )?non-?commercial (?:use|purposes)(?: only)?", "free for non-commercial use only"),
    ("no-warranty", "without any warranty", r"but without any warranty; without even the implied warranty of", "but WITHOUT ANY WARRANTY; without even the implied warranty of"),
    ("warranty-disclaimer", "software is provided", r"software is provided [\"']?as is[\"']?,? (?:and )?without warranty of any kind", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"),
]

# Tags that name a licence for machines.
TAGS = [
    ("spdx:{}", "spdx-license-identifier", r"spdx-license-identifier: ?([a-z0-9.+-]+)", "SPDX-License-Identifier: MIT"),
    ("mit", "license", r"license[\"']?\s*[:=]\s*[\"']?mit[\"']?(?![a-z0-9-])", "\"license\": \"MIT\""),
    ("apache-2.0", "license", r"license[\"']?\s*[:=]\s*[\"']?apache-2\.0", "license = \"Apache-2.0\""),
    ("gpl-3.0", "license", r"license[\"']?\s*[:=]\s*[\"']?gpl-3\.0", "license: GPL-3.0"),
    ("gpl-2.0", "license", r"license[\"']?\s*[:=]\s*[\"']?gpl-2\.0", "license: GPL-2.0"),
    ("bsd-3-clause", "license", r"license[\"']?\s*[:=]\s*[\"']?bsd-3-clause", "license: BSD-3-Clause"),
    ("bsd-2-clause", "license", r"license[\"']?\s*[:=]\s*[\"']?bsd-2-clause", "license: BSD-2-Clause"),
    ("isc", "license", r"license[\"']?\s*[:=]\s*[\"']?isc[\"']?(?![a-z0-9-])", "\"license\": \"ISC\""),
    ("mpl-2.0", "license", r"license[\"']?\s*[:=]\s*[\"']?mpl-2\.0", "license: MPL-2.0"),
    ("unlicensed", "unlicensed", r"license[\"']?\s*[:=]\s*[\"']?unlicensed", "\"license\": \"UNLICENSED\""),
    ("gpl-2.0", "module_license", r"module_license ?\( ?[\"']gpl(?: v2)?[\"']", "MODULE_LICENSE(\"GPL v2\")"),
    ("mit", "osi approved", r"license :: osi approved :: mit license", "License :: OSI Approved :: MIT License"),
    ("apache", "osi approved", r"license :: osi approved :: apache software license", "License :: OSI Approved :: Apache Software License"),
    ("bsd", "osi approved", r"license :: osi approved :: bsd license", "License :: OSI Approved :: BSD License"),
    ("mpl-2.0", "osi approved", r"license :: osi approved :: mozilla public license 2\.0", "License :: OSI Approved :: Mozilla Public License 2.0"),
]

# Licence names with a version, and grants by name.
VERSIONS = [
    ("agpl-3.0-or-later", "affero", r"affero general public licen[sc]e{v}3(?:\.0)?(?: \(?agplv?3?\)?)?,?(?: or \(?at your option\)? ?any later| or later)", "Affero General Public License v3 or later"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero (?:general public licen[sc]e|gpl){v}3(?:\.0)?{e}", "GNU Affero General Public License version 3"),
    ("agpl-1.0", "affero", r"affero (?:general public licen[sc]e|gpl){v}1(?:\.0)?{e}", "Affero General Public License version 1"),
    ("agpl-3.0-or-later", "agpl", r"agpl[- ]?v?3(?:\.0)?(?:-or-later|\+| or later)", "AGPL-3.0-or-later"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl{v}3(?:\.0)?(?:-only)?{e}", "AGPLv3"),
    ("agpl-1.0", "agpl", r"(?:gnu )?agpl{v}1(?:\.0)?{e}", "AGPL-1.0"),
    ("lgpl-2.1-or-later", "lesser", r"lesser general public licen[sc]e{v}2\.1(?: or \(?at your option\)? ?any later|,? or later)", "Lesser General Public License v2.1 or later"),
    ("lgpl-3.0-or-later", "lesser", r"lesser general public licen[sc]e{v}3(?:\.0)?(?: or \(?at your option\)? ?any later|,? or later)", "Lesser General Public License version 3 or later"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser (?:general public licen[sc]e|gpl){v}2\.1{e}", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser (?:general public licen[sc]e|gpl){v}3(?:\.0)?{e}", "GNU Lesser General Public License v3.0"),
    ("lgpl-2.0", "lesser", r"(?:gnu )?lesser (?:general public licen[sc]e|gpl){v}2(?:\.0)?{e}", "Lesser GPL 2"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licen[sc]e{v}2(?:\.0)?{e}", "GNU Library General Public License version 2"),
    ("lgpl-2.1-or-later", "lgpl", r"lgpl[- ]?v?2\.1(?:-or-later|\+| or later)", "LGPL-2.1-or-later"),
    ("lgpl-3.0-or-later", "lgpl", r"lgpl[- ]?v?3(?:\.0)?(?:-or-later|\+| or later)", "LGPLv3+"),
    ("lgpl-2.0-or-later", "lgpl", r"lgpl[- ]?v?2(?:\.0)?(?:-or-later|\+| or later)", "LGPL-2.0-or-later"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl{v}2\.1(?:-only)?{e}", "LGPL 2.1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl{v}3(?:\.0)?(?:-only)?{e}", "LGPLv3"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl{v}2(?:\.0)?(?:-only)?{e}", "LGPL v2"),
    ("gpl-3.0-or-later", "general public", r"general public licen[sc]e{v}3(?:\.0)?(?: or \(?at your option\)? ?any later|,? or later)", "General Public License version 3 or later"),
    ("gpl-2.0-or-later", "general public", r"general public licen[sc]e{v}2(?:\.0)?(?: or \(?at your option\)? ?any later|,? or later)", "General Public License v2 or later"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e{v}3(?:\.0)?{e}", "GNU General Public License v3"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e{v}2(?:\.0)?{e}", "GNU General Public License, version 2"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e{v}1(?:\.0)?{e}", "GNU General Public License version 1"),
    ("gpl-3.0-or-later", "gpl", r"gpl[- ]?v?3(?:\.0)?(?:-or-later|\+| or later)", "GPL-3.0-or-later"),
    ("gpl-2.0-or-later", "gpl", r"gpl[- ]?v?2(?:\.0)?(?:-or-later|\+| or later)", "GPLv2+"),
    ("gpl-1.0-or-later", "gpl", r"gpl[- ]?v?1(?:\.0)?(?:-or-later|\+| or later)", "GPL-1.0-or-later"),
    ("gpl-2.0-with-classpath-exception", "classpath", r"(?:gnu )?(?:gpl|general public licen[sc]e)[^.]{0,40} with (?:the )?classpath exception", "GPL v2 with the Classpath exception"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl{v}3(?:\.0)?(?:-only)?{e}", "GPLv3"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl{v}2(?:\.0)?(?:-only)?{e}", "GPL v2"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl{v}1(?:\.0)?(?:-only)?{e}", "GPL 1.0"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[sc]e{v}1\.3{e}", "GNU Free Documentation License 1.3"),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licen[sc]e{v}1\.2{e}", "GNU Free Documentation License, Version 1.2"),
    ("gfdl-1.1", "free documentation", r"(?:gnu )?free documentation licen[sc]e{v}1\.1{e}", "Free Documentation License 1.1"),
    ("gfdl-1.3", "gfdl", r"gfdl{v}1\.3{e}", "GFDL-1.3"),
    ("gfdl-1.2", "gfdl", r"gfdl{v}1\.2{e}", "GFDL 1.2"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[sc]e)?{v}2(?:\.0)?{e}", "Apache License, Version 2.0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[sc]e)?{v}1\.1{e}", "Apache Software License 1.1"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: licen[sc]e)?{v}1(?:\.0)?{e}", "Apache License 1.0"),
    ("apache-2.0", "asl", r"asl[- ]?2\.0{e}", "ASL 2.0"),
    ("apache-2.0", "al2", r"al2\.0{e}", "AL2.0"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e{v}2(?:\.0)?{e}", "Mozilla Public License 2.0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e{v}1\.1{e}", "Mozilla Public License 1.1"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[sc]e{v}1(?:\.0)?{e}", "Mozilla Public License 1.0"),
    ("mpl-2.0", "mpl", r"mpl{v}2(?:\.0)?{e}", "MPL 2.0"),
    ("mpl-1.1", "mpl", r"mpl{v}1\.1{e}", "MPL-1.1"),
    ("mpl-1.0", "mpl", r"mpl{v}1\.0{e}", "MPL 1.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e{v}2(?:\.0)?{e}", "Eclipse Public License v2.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e{v}1(?:\.0)?{e}", "Eclipse Public License 1.0"),
    ("epl-2.0", "epl", r"epl{v}2(?:\.0)?{e}", "EPL-2.0"),
    ("epl-1.0", "epl", r"epl{v}1(?:\.0)?{e}", "EPL 1.0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e{v}1(?:\.0)?{e}", "Eclipse Distribution License v1.0"),
    ("cddl-1.1", "common development", r"common development and distribution licen[sc]e{v}1\.1{e}", "Common Development and Distribution License 1.1"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e{v}1(?:\.0)?{e}", "Common Development and Distribution License version 1.0"),
    ("cddl-1.1", "cddl", r"cddl{v}1\.1{e}", "CDDL 1.1"),
    ("cddl-1.0", "cddl", r"cddl{v}1(?:\.0)?{e}", "CDDL-1.0"),
    ("cpl-1.0", "common public", r"common public licen[sc]e{v}1(?:\.0)?{e}", "Common Public License 1.0"),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e{v}1(?:\.0)?{e}", "IBM Public License 1.0"),
    ("cpal-1.0", "common public attribution", r"common public attribution licen[sc]e{v}1(?:\.0)?{e}", "Common Public Attribution License 1.0"),
    ("bsl-1.0", "boost", r"boost(?: software)? licen[sc]e(?: -)?{v}1(?:\.0)?{e}", "Boost Software License - Version 1.0"),
    ("busl-1.1", "business source", r"business source licen[sc]e{v}1\.1{e}", "Business Source License 1.1"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e{v}1(?:\.0)?{e}", "Server Side Public License v1"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e{v}2(?:\.0)?{e}", "Elastic License 2.0"),
    ("artistic-2.0", "artistic", r"(?:perl )?artistic licen[sc]e{v}2(?:\.0)?{e}", "Artistic License 2.0"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic licen[sc]e{v}1(?:\.0)?{e}", "Perl Artistic License 1.0"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e{v}1\.2{e}", "European Union Public Licence 1.2"),
    ("eupl-1.1", "european union", r"european union public licen[sc]e{v}1\.1{e}", "European Union Public Licence v. 1.1"),
    ("eupl-1.2", "eupl", r"eupl{v}1\.2{e}", "EUPL-1.2"),
    ("eupl-1.1", "eupl", r"eupl{v}1\.1{e}", "EUPL 1.1"),
    ("cecill-2.1", "cecill", r"cecill{v}2\.1{e}", "CeCILL 2.1"),
    ("cecill-2.0", "cecill", r"cecill{v}2(?:\.0)?{e}", "CeCILL v2"),
    ("cecill-b", "cecill", r"cecill-b(?: free software)?", "CeCILL-B"),
    ("cecill-c", "cecill", r"cecill-c(?: free software)?", "CeCILL-C"),
    ("osl-3.0", "open software", r"open software licen[sc]e{v}3(?:\.0)?{e}", "Open Software License 3.0"),
    ("osl-2.1", "open software", r"open software licen[sc]e{v}2\.1{e}", "Open Software License v2.1"),
    ("osl-2.0", "open software", r"open software licen[sc]e{v}2(?:\.0)?{e}", "Open Software License 2.0"),
    ("osl-1.1", "open software", r"open software licen[sc]e{v}1\.1{e}", "Open Software License 1.1"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e{v}3(?:\.0)?{e}", "Academic Free License 3.0"),
    ("afl-2.1", "academic free", r"academic free licen[sc]e{v}2\.1{e}", "Academic Free License version 2.1"),
    ("afl-2.0", "academic free", r"academic free licen[sc]e{v}2(?:\.0)?{e}", "Academic Free License 2.0"),
    ("qpl-1.0", "q public", r"q public licen[sc]e{v}1(?:\.0)?{e}", "Q Public License version 1.0"),
    ("npl-1.1", "netscape", r"netscape public licen[sc]e{v}1\.1{e}", "Netscape Public License 1.1"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e{v}1(?:\.0)?{e}", "Universal Permissive License v 1.0"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[sc]e", "University of Illinois/NCSA Open Source License"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software licen[sc]e){v}2(?:\.0)?{e}", "Mulan PSL v2"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e{v}1\.1{e}", "SIL Open Font License 1.1"),
    ("odbl-1.0", "open database", r"open database licen[sc]e{v}1(?:\.0)?{e}", "Open Database License v1.0"),
    ("odbl-1.0", "odbl", r"odbl{v}1\.0{e}", "ODbL 1.0"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e{v}1(?:\.0)?{e}", "Open Data Commons Attribution License v1.0"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[sc]e{v}1(?:\.0)?{e}", "Public Domain Dedication and License 1.0"),
    ("zpl-2.1", "zope", r"zope public licen[sc]e{v}2\.1{e}", "Zope Public License 2.1"),
    ("php-3.01", "php", r"php licen[sc]e{v}3\.01{e}", "PHP License 3.01"),
    ("psf-2.0", "python software", r"python software foundation licen[sc]e{v}2(?:\.0)?{e}", "Python Software Foundation License Version 2"),
    ("vim", "vim", r"vim licen[sc]e", "Vim license"),
    ("lppl-1.3c", "latex project", r"latex project public licen[sc]e{v}1\.3c?{e}", "LaTeX Project Public License 1.3c"),
    ("openrail-m", "openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?:\+\+|-m)(?: licen[sc]e)?", "CreativeML OpenRAIL-M"),
    ("cc-by-nc-nd-4.0", "by-nc-nd", r"cc[- ]by-nc-nd[- ]?4\.0{e}", "CC BY-NC-ND 4.0"),
    ("cc-by-nc-nd-3.0", "by-nc-nd", r"cc[- ]by-nc-nd[- ]?3\.0{e}", "CC BY-NC-ND 3.0"),
    ("cc-by-nc-nd-2.0", "by-nc-nd", r"cc[- ]by-nc-nd[- ]?2\.0{e}", "CC BY-NC-ND 2.0"),
    ("cc-by-nc-sa-4.0", "by-nc-sa", r"cc[- ]by-nc-sa[- ]?4\.0{e}", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa-3.0", "by-nc-sa", r"cc[- ]by-nc-sa[- ]?3\.0{e}", "CC BY-NC-SA 3.0"),
    ("cc-by-nc-sa-2.0", "by-nc-sa", r"cc[- ]by-nc-sa[- ]?2\.0{e}", "CC BY-NC-SA 2.0"),
    ("cc-by-nc-4.0", "by-nc", r"cc[- ]by-nc[- ]?4\.0{e}", "CC BY-NC 4.0"),
    ("cc-by-nc-3.0", "by-nc", r"cc[- ]by-nc[- ]?3\.0{e}", "CC BY-NC 3.0"),
    ("cc-by-nc-2.0", "by-nc", r"cc[- ]by-nc[- ]?2\.0{e}", "CC-BY-NC-2.0"),
    ("cc-by-nd-4.0", "by-nd", r"cc[- ]by-nd[- ]?4\.0{e}", "CC BY-ND 4.0"),
    ("cc-by-nd-3.0", "by-nd", r"cc[- ]by-nd[- ]?3\.0{e}", "CC BY-ND 3.0"),
    ("cc-by-sa-4.0", "by-sa", r"cc[- ]by-sa[- ]?4\.0{e}", "CC BY-SA 4.0"),
    ("cc-by-sa-3.0", "by-sa", r"cc[- ]by-sa[- ]?3\.0{e}", "CC-BY-SA-3.0"),
    ("cc-by-sa-2.5", "by-sa", r"cc[- ]by-sa[- ]?2\.5{e}", "CC BY-SA 2.5"),
    ("cc-by-sa-2.0", "by-sa", r"cc[- ]by-sa[- ]?2\.0{e}", "CC BY-SA 2.0"),
    ("cc-by-sa-1.0", "by-sa", r"cc[- ]by-sa[- ]?1\.0{e}", "CC BY-SA 1.0"),
    ("cc-by-4.0", "cc", r"cc[- ]by[- ]?4\.0{e}", "CC BY 4.0"),
    ("cc-by-3.0", "cc", r"cc[- ]by[- ]?3\.0{e}", "CC-BY-3.0"),
    ("cc-by-2.5", "cc", r"cc[- ]by[- ]?2\.5{e}", "CC BY 2.5"),
    ("cc-by-2.0", "cc", r"cc[- ]by[- ]?2\.0{e}", "CC BY 2.0"),
    ("cc-by-1.0", "cc", r"cc[- ]by[- ]?1\.0{e}", "CC BY 1.0"),
    ("cc0-1.0", "cc0", r"cc0[- ]?1\.0{e}", "CC0 1.0"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: universal)?{v}1(?:\.0)?{e}", "Creative Commons Zero v1.0"),
    ("cc-by-nc-nd-4.0", "noderiv", r"(?:creative commons )?attribution[- ]non-?commercial[- ]noderiv(?:ative)?s{v}4\.0{e}", "Attribution-NonCommercial-NoDerivatives 4.0"),
    ("cc-by-nc-nd-3.0", "noderiv", r"(?:creative commons )?attribution[- ]non-?commercial[- ]noderiv(?:ative)?s{v}3\.0{e}", "Attribution-NonCommercial-NoDerivs 3.0"),
    ("cc-by-nc-sa-4.0", "attribution", r"(?:creative commons )?attribution[- ]non-?commercial[- ]share-?alike{v}4\.0{e}", "Attribution-NonCommercial-ShareAlike 4.0"),
    ("cc-by-nc-sa-3.0", "attribution", r"(?:creative commons )?attribution[- ]non-?commercial[- ]share-?alike{v}3\.0{e}", "Attribution-NonCommercial-ShareAlike 3.0"),
    ("cc-by-nc-4.0", "attribution", r"(?:creative commons )?attribution[- ]non-?commercial{v}4\.0{e}", "Attribution-NonCommercial 4.0"),
    ("cc-by-nc-3.0", "attribution", r"(?:creative commons )?attribution[- ]non-?commercial{v}3\.0{e}", "Attribution-NonCommercial 3.0"),
    ("cc-by-nd-4.0", "noderiv", r"(?:creative commons )?attribution[- ]noderiv(?:ative)?s{v}4\.0{e}", "Attribution-NoDerivatives 4.0"),
    ("cc-by-nd-3.0", "noderiv", r"(?:creative commons )?attribution[- ]noderiv(?:ative)?s{v}3\.0{e}", "Attribution-NoDerivs 3.0"),
    ("cc-by-sa-4.0", "attribution", r"(?:creative commons )?attribution[- ]share-?alike{v}4\.0{e}", "Attribution-ShareAlike 4.0"),
    ("cc-by-sa-3.0", "attribution", r"(?:creative commons )?attribution[- ]share-?alike{v}3\.0{e}", "Creative Commons Attribution-ShareAlike 3.0"),
    ("cc-by-sa-2.5", "attribution", r"(?:creative commons )?attribution[- ]share-?alike{v}2\.5{e}", "Attribution-ShareAlike 2.5"),
    ("cc-by-sa-2.0", "attribution", r"(?:creative commons )?attribution[- ]share-?alike{v}2\.0{e}", "Attribution-ShareAlike 2.0"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution(?: international)?{v}4\.0{e}", "Creative Commons Attribution 4.0"),
    ("cc-by-3.0", "creative commons", r"creative commons attribution(?: unported)?{v}3\.0{e}", "Creative Commons Attribution 3.0"),
    ("cc-by-2.5", "creative commons", r"creative commons attribution{v}2\.5{e}", "Creative Commons Attribution 2.5"),
    ("cc-by-2.0", "creative commons", r"creative commons attribution{v}2\.0{e}", "Creative Commons Attribution 2.0"),
    ("bsd-2-clause", "bsd", r"(?:2-clause|two-clause|simplified|freebsd) bsd(?: licen[sc]e)?|bsd[- ]2-clause(?: licen[sc]e)?", "Simplified BSD License"),
    ("bsd-3-clause", "bsd", r"(?:3-clause|three-clause|new|modified|revised) bsd(?: licen[sc]e)?|bsd[- ]3-clause(?: licen[sc]e)?", "3-clause BSD license"),
    ("bsd-4-clause", "bsd", r"(?:4-clause|four-clause|original) bsd(?: licen[sc]e)?|bsd[- ]4-clause(?: licen[sc]e)?", "original BSD license"),
    ("0bsd", "bsd", r"0bsd|(?:zero-clause|0-clause) bsd(?: licen[sc]e)?", "Zero-Clause BSD"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "Microsoft Public License"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", "Microsoft Reciprocal License"),
    ("mit", "under", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit(?: licen[sc]e)?", "released under the MIT license"),
    ("apache", "under", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[sc]e(?!{v}[0-9])", "licensed under the Apache License"),
    ("bsd", "under", r"(?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?bsd(?:-style)?(?: licen[sc]e)?", "distributed under a BSD-style license"),
    ("gpl", "under", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl(?!{v}[0-9])", "released under the GNU GPL"),
    ("lgpl", "under", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl(?!{v}[0-9])", "available under the LGPL"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|put) (?:in)?to the public domain", "released into the public domain"),
    ("public-domain", "public domain", r"(?:is|are) in the public domain", "is in the public domain"),
    ("mit-or-apache-2.0", "mit", r"mit(?: licen[sc]e)? or (?:the )?apache(?: licen[sc]e)?(?:,? version)?[- ]2\.0", "MIT OR Apache-2.0"),
]

# Bare names.
NAMES = [
    ("mit", "mit license|mit licence", r"mit licen[sc]e", "MIT License"),
    ("x11", "x11", r"x11 licen[sc]e", "X11 license"),
    ("apache", "apache license|apache licence|apache software", r"apache(?: software)? licen[sc]e", "Apache License"),
    ("agpl", "affero general public", r"(?:gnu )?affero general public licen[sc]e", "Affero General Public License"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e", "Lesser General Public License"),
    ("lgpl", "library general public", r"(?:gnu )?library general public licen[sc]e", "Library General Public License"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", "GNU General Public License"),
    ("agpl", "agpl", r"agpl", "AGPL"),
    ("lgpl", "lgpl", r"lgpl", "LGPL"),
    ("gpl", "gpl", r"gpl", "GPL"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", "GNU Free Documentation License"),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e", "Mozilla Public License"),
    ("epl", "eclipse public", r"eclipse public licen[sc]e", "Eclipse Public License"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[sc]e", "Eclipse Distribution License"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", "Common Development and Distribution License"),
    ("cpl", "common public", r"common public licen[sc]e", "Common Public License"),
    ("bsl", "boost", r"boost(?: software)? licen[sc]e", "Boost license"),
    ("busl", "business source", r"business source licen[sc]e", "Business Source License"),
    ("sspl", "server side public", r"server side public licen[sc]e", "Server Side Public License"),
    ("elastic", "elastic licen", r"elastic licen[sc]e", "Elastic License"),
    ("artistic", "artistic licen", r"(?:perl )?artistic licen[sc]e", "Artistic License"),
    ("eupl", "european union public", r"european union public licen[sc]e", "European Union Public Licence"),
    ("osl", "open software licen", r"open software licen[sc]e", "Open Software License"),
    ("afl", "academic free", r"academic free licen[sc]e", "Academic Free License"),
    ("bsd", "bsd licen|bsd-style", r"bsd(?:-style)? licen[sc]e|bsd-style", "BSD license"),
    ("isc", "isc licen", r"isc licen[sc]e", "ISC License"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib license"),
    ("libpng", "libpng", r"libpng licen[sc]e", "libpng license"),
    ("openssl", "openssl licen", r"openssl licen[sc]e", "OpenSSL License"),
    ("ofl", "open font licen", r"(?:sil )?open font licen[sc]e", "SIL Open Font License"),
    ("odbl", "open database licen", r"open database licen[sc]e", "Open Database License"),
    ("wtfpl", "wtfpl", r"wtfpl", "WTFPL"),
    ("unlicense", "the unlicense", r"the unlicense", "The Unlicense"),
    ("postgresql", "postgresql licen", r"postgresql licen[sc]e", "PostgreSQL License"),
    ("psf", "python software foundation licen", r"python software foundation licen[sc]e", "Python Software Foundation License"),
    ("php", "php licen", r"php licen[sc]e", "PHP License"),
    ("ruby", "ruby", r"ruby(?:'s)? licen[sc]e", "Ruby license"),
    ("beerware", "beerware|beer-ware", r"beer-?ware(?: licen[sc]e)?", "Beerware"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", "Historical Permission Notice and Disclaimer"),
    ("cc0", "cc0", r"cc0", "CC0"),
    ("cc", "creative commons", r"creative commons", "Creative Commons"),
    ("open-government", "open government", r"open government licen[sc]e", "Open Government Licence"),
    ("eula", "end user licen|end-user licen", r"end[- ]user licen[sc]e agreement", "End User License Agreement"),
    ("shareware", "shareware", r"shareware", "shareware"),
    ("all-rights-reserved", "all rights", r"all rights reserved", "All rights reserved"),
    ("copyright", "copyright|(c)|©", r"(?:copyright|\(c\)|©) ?(?:\(c\)|©)? ?(?:19|20)[0-9]{2}", "Copyright (c) 2020"),
]
