"""Signatures of license texts for ``licenses``: titles, grants, conditions, disclaimers and headers, as written by hand.

A blank in a phrase stands for any separators (none with " ?"). Each entry names a word that every match holds.
"""

from __future__ import annotations

_V = r"(?: v(?:ersion)?)?"

#: Titles with their versions: label, keyword, phrase.
TITLES = (
    ("lgpl-2.0", "library", rf"(?:gnu )?library general public license{_V} ?2(?: 0)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public license{_V} ?2 1"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public license{_V} ?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("gpl-1.0", "general", rf"(?:gnu )?general public license{_V} ?1(?: 0)?"),
    ("gpl-2.0", "general", rf"(?:gnu )?general public license{_V} ?2(?: 0)?"),
    ("gpl-3.0", "general", rf"(?:gnu )?general public license{_V} ?3(?: 0)?"),
    ("gpl-2.0-or-later", "later", rf"(?:gnu )?general public license{_V} ?2(?: 0)? or (?:at your option )?(?:any )?later"),
    ("gpl-3.0-or-later", "later", rf"(?:gnu )?general public license{_V} ?3(?: 0)? or (?:at your option )?(?:any )?later"),
    ("lgpl-2.1-or-later", "later", rf"(?:gnu )?lesser general public license{_V} ?2 1 or (?:at your option )?(?:any )?later"),
    ("lgpl-3.0-or-later", "later", rf"(?:gnu )?lesser general public license{_V} ?3(?: 0)? or (?:at your option )?(?:any )?later"),
    ("agpl-3.0-or-later", "later", rf"(?:gnu )?affero general public license{_V} ?3(?: 0)? or (?:at your option )?(?:any )?later"),
    ("agpl-1.0", "affero", rf"(?:gnu )?affero general public license{_V} ?1(?: 0)?"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public license(?:{_V} ?3(?: 0)?)?"),
    ("gfdl-1.1", "documentation", rf"free documentation license{_V} ?1 1"),
    ("gfdl-1.2", "documentation", rf"free documentation license{_V} ?1 2"),
    ("gfdl-1.3", "documentation", rf"free documentation license{_V} ?1 3"),
    ("mit", "mit", r"(?:the )?mit license"),
    ("mit-0", "attribution", r"mit no attribution(?: license)?"),
    ("x11", "x11", r"x11 license"),
    ("apache-1.0", "apache", rf"apache(?: software)? license{_V} ?1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? license{_V} ?1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)? license{_V} ?2(?: 0)?"),
    ("bsd", "bsd", r"(?:the )?bsd(?: style)? license"),
    ("0bsd", "bsd", r"(?:bsd zero clause|zero clause bsd) license"),
    ("bsd-1-clause", "clause", r"(?:bsd 1 clause|1 clause bsd) license"),
    ("bsd-2-clause", "clause", r"(?:bsd 2 clause|2 clause bsd)(?: license)?"),
    ("bsd-2-clause-patent", "patent", r"bsd 2 clause(?: plus)? patent license"),
    ("bsd-3-clause", "clause", r"(?:bsd 3 clause|3 clause bsd)(?: license)?"),
    ("bsd-3-clause-clear", "clear", r"(?:bsd 3 clause clear|clear bsd)(?: license)?"),
    ("bsd-4-clause", "clause", r"(?:bsd 4 clause|4 clause bsd)(?: license)?"),
    ("edl-1.0", "eclipse", rf"eclipse distribution license(?:{_V} ?1 0)?"),
    ("epl-1.0", "eclipse", rf"eclipse public license{_V} ?1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public license{_V} ?2(?: 0)?"),
    ("mpl-1.0", "mozilla", rf"mozilla public license{_V} ?1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public license{_V} ?1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public license{_V} ?2(?: 0)?"),
    ("artistic-1.0", "artistic", rf"artistic license{_V} ?1(?: 0)?"),
    ("artistic-2.0", "artistic", rf"artistic license{_V} ?2(?: 0)?"),
    ("elastic-2.0", "elastic", rf"elastic license{_V} ?2(?: 0)?"),
    ("busl-1.1", "business", rf"business source license(?:{_V} ?1 1)?"),
    ("sspl-1.0", "server", rf"server side public license(?:{_V} ?1(?: 0)?)?"),
    ("commons-clause", "commons", r"commons clause license condition"),
    ("polyform-noncommercial-1.0.0", "polyform", rf"polyform noncommercial license(?:{_V} ?1 0 0)?"),
    ("polyform-small-business-1.0.0", "polyform", rf"polyform small business license(?:{_V} ?1 0 0)?"),
    ("confluent-community-1.0", "confluent", rf"confluent community license(?: agreement)?(?:{_V} ?1 0)?"),
    ("parity-7.0.0", "parity", rf"parity public license{_V} ?7(?: 0 0)?"),
    ("osl-3.0", "open", rf"open software license{_V} ?3 0"),
    ("afl-3.0", "academic", rf"academic free license{_V} ?3 0"),
    ("ecl-2.0", "educational", rf"educational community license{_V} ?2 0"),
    ("upl-1.0", "universal", rf"universal permissive license(?:{_V} ?1 0)?"),
    ("mulanpsl-2.0", "mulan", rf"mulan(?: permissive software license|psl){_V} ?2"),
    ("blueoak-1.0.0", "blue", rf"blue oak model license(?:{_V} ?1 0 0)?"),
    ("cecill-2.1", "cecill", rf"cecill(?: free software license agreement)?{_V} ?2 1"),
    ("cecill-b", "cecill", r"cecill b(?: free software license agreement)?"),
    ("cecill-c", "cecill", r"cecill c(?: free software license agreement)?"),
    ("eupl-1.1", "european", rf"european union public licen[cs]e{_V} ?1 1"),
    ("eupl-1.2", "european", rf"european union public licen[cs]e{_V} ?1 2"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("cddl-1.0", "common", rf"common development and distribution license(?: cddl)?{_V} ?1 0"),
    ("cddl-1.1", "common", rf"common development and distribution license(?: cddl)?{_V} ?1 1"),
    ("cpl-1.0", "common", rf"common public license{_V} ?1 0"),
    ("cpal-1.0", "common", rf"common public attribution license{_V} ?1 0"),
    ("ipl-1.0", "ibm", rf"ibm public license{_V} ?1 0"),
    ("spl-1.0", "sun", rf"sun public license{_V} ?1 0"),
    ("npl-1.1", "netscape", rf"netscape public license{_V} ?1 1"),
    ("qpl-1.0", "public", rf"q public license(?:{_V} ?1 0)?"),
    ("apsl-2.0", "apple", rf"apple public source license{_V} ?2 0"),
    ("nasa-1.3", "nasa", rf"nasa open source agreement{_V} ?1 3"),
    ("rpl-1.5", "reciprocal", rf"reciprocal public license{_V} ?1 5"),
    ("lppl-1.3c", "latex", rf"latex project public license{_V} ?1 3(?: ?c)?"),
    ("lppl", "latex", r"latex project public license"),
    ("ofl-1.1", "open", rf"(?:sil )?open font license(?:{_V} ?1 1)?"),
    ("bsl-1.0", "boost", rf"boost software license(?:{_V} ?1 0)?"),
    ("bitstream-vera", "bitstream", r"bitstream vera fonts copyright"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license"),
    ("vim", "vim", r"vim license"),
    ("ruby", "ruby", r"ruby license"),
    ("psf-2.0", "python", rf"python software foundation license{_V} ?2"),
    ("php-3.01", "php", rf"php license{_V} ?3 01"),
    ("zend-2.0", "zend", rf"zend engine license{_V} ?2 0"),
    ("zpl-2.1", "zope", rf"zope public license{_V} ?2 1"),
    ("w3c", "w3c", r"w3c software(?: and document)?(?: notice and)? license"),
    ("openssl", "openssl", r"openssl license"),
    ("ssleay", "ssleay", r"original ssleay license"),
    ("icu", "icu", r"icu license"),
    ("unicode-3.0", "unicode", rf"unicode license(?: agreement)?{_V} ?3"),
    ("curl", "curl", r"curl license"),
    ("libpng-2.0", "png", rf"png reference library license{_V} ?2"),
    ("odbl-1.0", "database", rf"open database license{_V} ?1 0"),
    ("odc-by-1.0", "commons", rf"open data commons attribution license(?:{_V} ?1 0)?"),
    ("pddl-1.0", "dedication", r"public domain dedication and license"),
    ("cdla-permissive-2.0", "community", rf"community data license agreement permissive{_V} ?2 0"),
    ("cdla-sharing-1.0", "community", rf"community data license agreement sharing{_V} ?1 0"),
    ("cc0-1.0", "universal", r"cc0 1 0 universal"),
    ("cc-by-nc-nd", "deriv", r"attribution non ?commercial no ?deriv(?:ative)?s"),
    ("openrail", "responsible", r"(?:creativeml )?open ?rail(?: m| ?m)? responsible ai license"),
    ("llama", "llama", r"llama(?: \d)? community license agreement"),
    ("gemma", "gemma", r"gemma terms of use license"),
    ("ms-pl", "microsoft", r"microsoft public license ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license ms rl"),
    ("json", "good", r"software shall be used for good not evil"),
    ("beerware", "beer", r"beer ?ware license(?: revision 42)?"),
    ("wtfpl", "public", r"do what the f\w+ you want to public license"),
)

#: Exceptions that are granted beside a license: label, keyword, phrase.
EXCEPTIONS = (
    ("classpath-exception-2.0", "exception", r"classpath exception"),
    ("classpath-exception-2.0", "special", r"as a special exception the copyright holders of this library give you permission to link"),
    ("gcc-exception-3.1", "exception", r"gcc runtime library exception"),
    ("llvm-exception", "exception", r"llvm exceptions? to the apache"),
    ("autoconf-exception-3.0", "exception", r"autoconf configure script exception"),
    ("bison-exception-2.2", "special", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("font-exception-2.0", "special", r"as a special exception if you create a document which uses this font"),
    ("openssl-exception", "special", r"as a special exception(?: the)?(?: \w+){0,6} permission to link(?: \w+){0,8} with the openssl library"),
    ("linux-syscall-note", "kernel", r"this copyright does not cover user programs that use kernel services by normal system calls"),
    ("qt-gpl-exception-1.0", "exception", r"the qt company gpl exception"),
)

#: Sentences of license texts and headers: label, keyword, phrase, priority, weight.
SENTENCES = (
    ("mit", "warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the "
     r"warranties of merchantability", 90, 0.95),
    ("mit", "substantial", r"(?:the above copyright notice and this permission notice|this permission notice) shall be included in all copies or "
     r"substantial portions of the software", 90, 0.95),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software", 90, 0.95),
    ("mit", "liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 89, 0.9),
    ("isc", "warranties", r"the software is provided as is and the author disclaims all warranties", 90, 0.9),
    ("isc", "loss", r"resulting from loss of use data or profits whether in an action of contract negligence or other tortious action", 88, 0.85),
    ("0bsd", "without", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", 91, 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 89, 0.95),
    ("bsd", "warranties", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties", 89, 0.95),
    ("bsd", "liable", r"in no event shall the (?:copyright (?:owner|holder)|regents) or contributors be liable", 88, 0.9),
    ("bsd-3-clause", "neither", r"neither the name of(?: \w+){1,8} nor the names of its contributors may be used to endorse", 91, 0.95),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 91, 0.97),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license", 92, 0.97),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at http(?:s)? www "
     r"apache org licenses license 2 0", 93, 0.99),
    ("apache-2.0", "apache", r"apache org licenses license 2 0", 90, 0.97),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
     r"basis", 86, 0.85),
    ("apache-2.0", "reproduction", r"terms and conditions for use reproduction and distribution", 85, 0.8),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 80, 0.7),
    ("gpl", "hope", r"this program is distributed in the hope that it will be useful but without any warranty", 88, 0.95),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with", 88, 0.95),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 93, 0.99),
    ("gpl-2.0", "take", r"the licenses for most software are designed to take away your freedom to share and change it", 90, 0.95),
    ("gpl-2.0", "version", r"under the terms of version 2 of the gnu general public license", 92, 0.97),
    ("gpl-3.0", "version", r"under the terms of version 3 of the gnu general public license", 92, 0.97),
    ("gpl-2.0", "only", r"general public license version 2 only", 93, 0.97),
    ("gpl-3.0", "only", r"general public license version 3 only", 93, 0.97),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 90, 0.95),
    ("lgpl-2.1", "successor", r"this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license", 93, 0.99),
    ("lgpl-3.0", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 93, 0.99),
    ("agpl-3.0", "remotely", r"if you modify the program your modified version must prominently offer all users interacting with it remotely", 93, 0.98),
    ("agpl-3.0", "received", r"you should have received a copy of the gnu affero general public license along with", 92, 0.97),
    ("mpl-2.0", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at http(?:s)? mozilla org", 93, 0.99),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 93, 0.99),
    ("epl-2.0", "eclipse", r"made available under the terms of the eclipse public license(?: v(?:ersion)?)? ?2 0", 93, 0.99),
    ("epl-1.0", "eclipse", r"made available under the terms of the eclipse public license(?: v(?:ersion)?)? ?1 0", 93, 0.99),
    ("cddl-1.0", "common", r"the contents of this file are subject to the terms of the common development and distribution license", 92, 0.97),
    ("bsl-1.0", "boost", r"distributed under the boost software license version 1 0", 93, 0.99),
    ("bsl-1.0", "machine", r"unless such copies or derivative works are solely in the form of machine executable object code", 92, 0.98),
    ("unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software", 92, 0.99),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 92, 0.98),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 91, 0.97),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license", 93, 0.99),
    ("ofl-1.1", "reserved", r"with reserved font name", 80, 0.8),
    ("perl-5", "perl", r"under the same terms as perl itself", 85, 0.9),
    ("ruby", "ruby", r"under the same terms as ruby(?: itself)?", 85, 0.9),
    ("cc0-1.0", "waive", r"(?:to the extent possible under law|has waived)(?: \w+){1,12} waived all copyright and related or neighboring rights", 92, 0.98),
    ("postgresql", "enhancements", r"to provide maintenance support updates enhancements or modifications", 85, 0.85),
    ("busl-1.1", "additional", r"additional use grant", 82, 0.8),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service", 93, 0.98),
    ("elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service", 93, 0.98),
    ("commons-clause", "sell", r"the license does not grant to you the right to sell the software", 91, 0.95),
    ("ms-pl", "contributor", r"each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution", 88, 0.8),
    ("proprietary", "disclosed", r"may not be (?:copied|reproduced) disclosed or distributed(?: \w+){0,6} without", 80, 0.8),
    ("proprietary", "trade", r"contains trade secrets of", 70, 0.7),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use)(?: or distribution)? of this (?:file|software|document|work)", 82, 0.85),
    ("cc-by", "creative", r"this work is licensed under a creative commons attribution(?: \d \d)?(?: international| unported)? license", 93, 0.98),
    ("cc-by-sa", "alike", r"this work is licensed under a creative commons attribution share ?alike(?: \d \d)?(?: international| unported)? license", 94, 0.98),
)

#: Identifiers of license expressions.
IDENTIFIERS = frozenset("""
0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-1.0-perl artistic-2.0 beerware
bitstream-vera blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause
bsd-source-code bsl-1.0 busl-1.1 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0
cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0
cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cdla-permissive-1.0 cdla-permissive-2.0 cdla-sharing-1.0 cecill-2.0 cecill-2.1 cecill-b cecill-c
cpal-1.0 cpl-1.0 curl ecl-2.0 edl-1.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0
gpl-2.0 gpl-3.0 hpnd icu ijg imagemagick intel ipl-1.0 isc jasper-2.0 json lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng libpng-2.0 libtiff
lppl-1.3c mit mit-0 mit-cmu mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 naist-2003 nasa-1.3 ncsa
net-snmp nist-pd npl-1.1 ntp odbl-1.0 odc-by-1.0 ofl-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql psf-2.0
python-2.0 qpl-1.0 rpl-1.5 ruby sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zend-2.0 zlib
zlib-acknowledgement zpl-2.1
""".split())
