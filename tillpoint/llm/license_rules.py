"""Signature rules of licenses, in order: earlier rules win ties.

A line is ``class keyword label: pattern``. Class 1 is wording of a license or notice itself, 2 a name with its
version or an identifier, 3 a name, 4 a clue. The keyword is a word without which the pattern can't match. The pattern is
a regular expression over lower-case words with one space between two of them; it starts with a word or with a
choice of words in parentheses, and spans at most SPAN words.
"""

SPAN = 32

RULES = """
1 permission mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 sublicense mit: use copy modify merge publish distribute sublicense and or sell copies of the software
1 permission isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
1 permission 0bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 permission isc: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
1 permission hpnd: permission to use copy modify and distribute this software and its documentation for any purpose( and without fee)? is hereby granted
1 permission postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
1 permission ofl-1.1: permission is hereby granted free of charge to any person obtaining a copy of the font software
1 permission unicode: permission is hereby granted free of charge to any person obtaining a copy of (the )?(unicode )?data files
1 permission bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
1 permission ncsa: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software
1 verbatim gpl: everyone is permitted to copy and distribute verbatim copies of this license document
1 redistribute gpl-2.0-or-later: redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
1 redistribute gpl-3.0-or-later: redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
1 redistribute gpl-2.0: redistribute it and or modify it under the terms of the gnu general public license version 2
1 redistribute gpl-3.0: redistribute it and or modify it under the terms of the gnu general public license version 3
1 redistribute gpl: redistribute it and or modify it under the terms of the gnu general public license
1 redistribute lgpl-2.1-or-later: redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
1 redistribute lgpl-3.0-or-later: redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
1 redistribute lgpl: redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
1 redistribute agpl-3.0-or-later: redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
1 redistribute agpl: redistribute it and or modify it under the terms of the gnu affero general public license
1 document gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 redistribution bsd-3-clause: redistribution and use in source and binary forms with or without modification are permitted provided that the following( three)? conditions are met
1 redistribution bsd: redistribution and use in source and binary forms with or without modification
1 redistributions bsd: redistributions (of source code|in binary form) must (retain|reproduce) the above copyright notice
1 endorse bsd-3-clause: neither the name of( [^ ]+){1,9} nor the names of its contributors may be used to endorse or promote products
1 advertising bsd-4-clause: advertising materials mentioning features or use of this software must display the following acknowledge?ment
1 apache apache-2.0: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 compliance apache-2.0: compliance with the license you may obtain a copy of the license
1 limitations apache-2.0: license for the specific language governing permissions and limitations under the license
1 mozilla mpl-2.0: subject to the terms of the mozilla public license v 2 0
1 mpl mpl-2.0: copy of the mpl was not distributed with this file
1 mozilla mpl-1.1: contents of this file are subject to the mozilla public license version 1 1
1 eclipse epl-2.0: accompanying materials are made available under the terms of the eclipse public license (v|version )?2 0
1 eclipse epl-1.0: accompanying materials are made available under the terms of the eclipse public license (v|version )?1 0
1 eclipse epl: made available under the terms of the eclipse public license
1 unencumbered unlicense: free and unencumbered software released into the public domain
1 dedicate public-domain: (dedicate|dedicates|dedicated) (this|the) (work|software|code) to the public domain
1 waived cc0-1.0: waived all copyright and related( or neighboring)? rights
1 misrepresented zlib: origin of this software must not be misrepresented
1 altered zlib: altered source versions must be plainly marked as such
1 freely zlib: alter it and redistribute it freely subject to the following restrictions
1 want wtfpl: just do what the (fuck|f)( [^ ]+)? you want to
1 beer beerware: buy me a beer in return
1 evil json: software shall be used for good not evil
1 jpeg ijg: based in part on the work of the independent jpeg group
1 python psf-2.0: psf is making python available to licensee on an as is basis
1 openssl openssl: developed by the openssl project for use in the openssl toolkit
1 cryptographic ssleay: cryptographic software written by eric young
1 php php-3.01: includes php software freely available from
1 tex lppl-1.3c: distributed and or modified under the conditions of the latex project public license
1 sell commons-clause: license does not include and the license does not grant to you the right to sell the software
1 production busl-1.1: licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
1 confidential proprietary: (proprietary|confidential) and (confidential|proprietary)
1 prohibited proprietary: unauthorized (copying|use|reproduction|distribution) of this (file|document|software|work)( via any medium)? is( strictly)? prohibited
1 reproduced proprietary: part of this (publication|document|work|book) may be reproduced
2 spdx mit: spdx license identifier mit
2 spdx apache-2.0: spdx license identifier apache 2 0
2 spdx gpl-2.0-or-later: spdx license identifier gpl 2 0( or later)
2 spdx gpl-2.0: spdx license identifier gpl 2 0( only)?
2 spdx gpl-3.0-or-later: spdx license identifier gpl 3 0 or later
2 spdx gpl-3.0: spdx license identifier gpl 3 0( only)?
2 spdx lgpl-2.1-or-later: spdx license identifier lgpl 2 1 or later
2 spdx lgpl-2.1: spdx license identifier lgpl 2 1( only)?
2 spdx lgpl-3.0: spdx license identifier lgpl 3 0( only| or later)?
2 spdx agpl-3.0: spdx license identifier agpl 3 0( only| or later)?
2 spdx bsd-2-clause: spdx license identifier bsd 2 clause
2 spdx bsd-3-clause: spdx license identifier bsd 3 clause
2 spdx mpl-2.0: spdx license identifier mpl 2 0
2 spdx isc: spdx license identifier isc
2 spdx epl-2.0: spdx license identifier epl 2 0
2 spdx cc0-1.0: spdx license identifier cc0 1 0
2 spdx unlicense: spdx license identifier unlicense
2 spdx zlib: spdx license identifier zlib
2 spdx bsl-1.0: spdx license identifier bsl 1 0
2 spdx spdx-other: spdx license identifier [^ ]+
2 apache apache-2.0: apache( software)? licen[cs]e( version| v)? 2( 0)?
2 apache apache-1.1: apache( software)? licen[cs]e( version| v)? 1 1
2 apache apache-1.0: apache( software)? licen[cs]e( version| v)? 1 0
2 apache apache-2.0: apache 2( 0)?( licen[cs]ed?)?
2 apache apache-2.0: apache org licenses license 2 0
2 apachev2 apache-2.0: apachev2( license)?
2 asl apache-2.0: asl 2 0
2 gnu gpl-3.0-or-later: gnu( general public licen[cs]e| gpl)( version| v)? 3( 0)? or( any)? later
2 gnu gpl-2.0-or-later: gnu( general public licen[cs]e| gpl)( version| v)? 2( 0)? or( any)? later
2 gnu gpl-3.0: gnu( general public licen[cs]e| gpl)( version| v)? 3( 0)?
2 gnu gpl-2.0: gnu( general public licen[cs]e| gpl)( version| v)? 2( 0)?
2 gnu gpl-1.0: gnu( general public licen[cs]e| gpl)( version| v)? 1( 0)?
2 gnu gpl-3.0: gnu gpl ?v3
2 gnu gpl-2.0: gnu gpl ?v2
2 gpl gpl-3.0-or-later: gpl( version| v)? 3( 0)? or( any)? later
2 gpl gpl-2.0-or-later: gpl( version| v)? 2( 0)? or( any)? later
2 gpl gpl-3.0: gpl( version| v)? 3( 0)?
2 gpl gpl-2.0: gpl( version| v)? 2( 0)?
2 gplv3 gpl-3.0: gplv3
2 gplv2 gpl-2.0: gplv2
2 gpl gpl-3.0: gpl v3
2 gpl gpl-2.0: gpl v2
2 general gpl-3.0: general public licen[cs]e( version| v)? 3( 0)?
2 general gpl-2.0: general public licen[cs]e( version| v)? 2( 0)?
2 lesser lgpl-3.0: gnu lesser general public licen[cs]e( version| v)? 3( 0)?
2 lesser lgpl-2.1: gnu lesser general public licen[cs]e( version| v)? 2 1
2 lesser lgpl-3.0: lesser general public licen[cs]e( version| v)? 3( 0)?
2 lesser lgpl-2.1: lesser general public licen[cs]e( version| v)? 2 1
2 library lgpl-2.0: library general public licen[cs]e( version| v)? 2( 0)?
2 lgpl lgpl-3.0: lgpl( version| v)? 3( 0)?
2 lgpl lgpl-2.1: lgpl( version| v)? 2 1
2 lgpl lgpl-2.0: lgpl( version| v)? 2( 0)?
2 lgplv3 lgpl-3.0: lgplv3
2 lgplv2 lgpl-2.1: lgplv2( 1)?
2 affero agpl-3.0: gnu affero general public licen[cs]e( version| v)? 3( 0)?
2 affero agpl-3.0: affero general public licen[cs]e( version| v)? 3( 0)?
2 affero agpl-1.0: affero general public licen[cs]e( version| v)? 1( 0)?
2 agpl agpl-3.0: agpl( version| v)? 3( 0)?
2 agplv3 agpl-3.0: agplv3
2 documentation gfdl-1.3: gnu free documentation licen[cs]e( version| v)? 1 3
2 documentation gfdl-1.2: gnu free documentation licen[cs]e( version| v)? 1 2
2 documentation gfdl-1.1: gnu free documentation licen[cs]e( version| v)? 1 1
2 gfdl gfdl-1.3: gfdl( version| v)? 1 3
2 gnu gpl: gnu org licenses gpl
2 gnu lgpl: gnu org licenses lgpl
2 gnu agpl: gnu org licenses agpl
2 bsd bsd-3-clause: bsd 3 clause( licen[cs]e)?
2 bsd bsd-2-clause: bsd 2 clause( licen[cs]e)?
2 bsd bsd-4-clause: bsd 4 clause( licen[cs]e)?
2 bsd 0bsd: bsd 0 clause( licen[cs]e)?
2 bsd bsd-3-clause: (3|three) clause bsd( licen[cs]e)?
2 bsd bsd-2-clause: (2|two) clause bsd( licen[cs]e)?
2 bsd bsd-4-clause: (4|four) clause bsd( licen[cs]e)?
2 bsd bsd-3-clause: (new|modified|revised) bsd licen[cs]e
2 bsd bsd-2-clause: (simplified|freebsd) bsd licen[cs]e
2 bsd bsd-4-clause: (original|old) bsd licen[cs]e
2 cc cc-by-nc-nd-4.0: cc by nc nd 4 0
2 cc cc-by-nc-nd-3.0: cc by nc nd 3 0
2 cc cc-by-nc-nd: cc by nc nd( [12] [05])?
2 cc cc-by-nc-sa-4.0: cc by nc sa 4 0
2 cc cc-by-nc-sa-3.0: cc by nc sa 3 0
2 cc cc-by-nc-sa: cc by nc sa( [12] [05])?
2 cc cc-by-nc-4.0: cc by nc 4 0
2 cc cc-by-nc-3.0: cc by nc 3 0
2 cc cc-by-nc: cc by nc( [12] [05])?
2 cc cc-by-nd-4.0: cc by nd 4 0
2 cc cc-by-nd: cc by nd( [123] [05])?
2 cc cc-by-sa-4.0: cc by sa 4 0
2 cc cc-by-sa-3.0: cc by sa 3 0
2 cc cc-by-sa-2.5: cc by sa 2 5
2 cc cc-by-sa: cc by sa( [12] 0)?
2 cc cc-by-4.0: cc by 4 0
2 cc cc-by-3.0: cc by 3 0
2 cc cc-by-2.5: cc by 2 5
2 cc cc-by-2.0: cc by 2 0
2 cc cc-by: cc by
2 cc0 cc0-1.0: cc0( 1 0| 1| universal)?( universal)?
2 cc cc0-1.0: cc (0|zero)( 1 0)?
2 creativecommons cc-by-nc-nd: creativecommons org licenses by nc nd( [1234] [05])?
2 creativecommons cc-by-nc-sa: creativecommons org licenses by nc sa( [1234] [05])?
2 creativecommons cc-by-nc: creativecommons org licenses by nc( [1234] [05])?
2 creativecommons cc-by-nd: creativecommons org licenses by nd( [1234] [05])?
2 creativecommons cc-by-sa: creativecommons org licenses by sa( [1234] [05])?
2 creativecommons cc-by: creativecommons org licenses by( [1234] [05])?
2 creativecommons cc0-1.0: creativecommons org publicdomain zero
2 creativecommons public-domain: creativecommons org publicdomain mark
2 commons cc-by-nc-nd-4.0: creative commons attribution non ?commercial no ?deriv(ative)?s( international)? 4 0( international)?
2 commons cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(ative)?s
2 commons cc-by-nc-sa-4.0: creative commons attribution non ?commercial share ?alike( international)? 4 0( international)?
2 commons cc-by-nc-sa: creative commons attribution non ?commercial share ?alike
2 commons cc-by-nc-4.0: creative commons attribution non ?commercial( international)? 4 0( international)?
2 commons cc-by-nc: creative commons attribution non ?commercial
2 commons cc-by-nd: creative commons attribution no ?deriv(ative)?s
2 commons cc-by-sa-4.0: creative commons attribution share ?alike( international)? 4 0( international)?
2 commons cc-by-sa-3.0: creative commons attribution share ?alike( unported)? 3 0( unported)?
2 commons cc-by-sa: creative commons attribution share ?alike
2 commons cc-by-4.0: creative commons attribution( international)? 4 0( international)?
2 commons cc-by-3.0: creative commons attribution( unported)? 3 0( unported)?
2 commons cc-by: creative commons attribution
2 commons cc0-1.0: creative commons (zero|cc0)( 1 0)?
2 mozilla mpl-2.0: mozilla public licen[cs]e( version| v)? 2( 0)?
2 mozilla mpl-1.1: mozilla public licen[cs]e( version| v)? 1 1
2 mpl mpl-2.0: mpl( version| v)? 2( 0)?
2 mpl mpl-1.1: mpl( version| v)? 1 1
2 mozilla mpl-2.0: mozilla org mpl 2 0
2 eclipse epl-2.0: eclipse public licen[cs]e( version| v)? 2( 0)?
2 eclipse epl-1.0: eclipse public licen[cs]e( version| v)? 1( 0)?
2 epl epl-2.0: epl( version| v)? 2( 0)?
2 epl epl-1.0: epl( version| v)? 1( 0)?
2 cddl cddl-1.1: cddl( version| v)? 1 1
2 cddl cddl-1.0: cddl( version| v)? 1( 0)?
2 development cddl-1.0: common development and distribution licen[cs]e( version| v)?( 1 0)?
2 common cpl-1.0: common public licen[cs]e( version| v)?( 1 0)?
2 eupl eupl-1.2: eupl( version| v)? 1 2
2 eupl eupl-1.1: eupl( version| v)? 1 1
2 european eupl: european union public licen[cs]e( version| v)?( 1 [12])?
2 artistic artistic-2.0: artistic licen[cs]e( version| v)? 2( 0)?
2 artistic artistic-1.0: artistic licen[cs]e( version| v)? 1( 0)?
2 boost bsl-1.0: boost software licen[cs]e( version| v)?( 1 0| 1)?
2 python psf-2.0: python software foundation licen[cs]e( version| v)?( 2)?
2 font ofl-1.1: sil open font licen[cs]e( version| v)?( 1 1)?
2 ofl ofl-1.1: ofl( version| v)? 1 1
2 database odbl-1.0: open database licen[cs]e( odbl)?( version| v)?( 1 0)?
2 odbl odbl-1.0: odbl( 1 0)?
2 commons odc-by-1.0: open data commons attribution licen[cs]e
2 commons pddl-1.0: open data commons public domain dedication
2 microsoft ms-pl: microsoft public licen[cs]e
2 microsoft ms-rl: microsoft reciprocal licen[cs]e
2 side sspl-1.0: server side public licen[cs]e( version| v)?( 1)?
2 sspl sspl-1.0: sspl( 1 0)?
2 business busl-1.1: business source licen[cs]e( version| v)?( 1 1)?
2 elastic elastic-2.0: elastic licen[cs]e( version| v)?( 2 0| 2)?
2 zope zpl-2.1: zope public licen[cs]e( version| v)?( 2 1)?
2 php php-3.01: php licen[cs]e( version| v)?( 3 01)?
2 latex lppl-1.3c: latex project public licen[cs]e( version| v)?( 1 3c?)?
2 academic afl-3.0: academic free licen[cs]e( version| v)?( 3 0)?
2 open osl-3.0: open software licen[cs]e( version| v)?( 3 0)?
2 wtfpl wtfpl: (wtfpl|wtfplv2)
2 government ogl-uk-3.0: open government licen[cs]e( version| v)?( 3 0)?
2 etalab etalab-2.0: licence ouverte( etalab)?
2 cecill cecill: cecill( [abc])?( version| v)?( 2 [01])?
2 bigscience openrail: bigscience( open)? rail( m)?( licen[cs]e)?
2 openrail openrail: openrail( m)?
2 llama llama-community: llama [1234]( [1234])? community licen[cs]e
3 mit mit: mit licen[cs]ed?
3 mit mit: mit x11 licen[cs]e
3 expat mit: expat licen[cs]e
3 opensource mit: opensource org licenses mit
3 mit mit: licensed under( the)? mit
3 x11 x11: x11 licen[cs]e
3 apache apache: apache( software)? licen[cs]ed?
3 gnu gpl: gnu( general public licen[cs]e| gpl)
3 general gpl: general public licen[cs]e
3 gpl gpl: gpl( licen[cs]ed?)?
3 lesser lgpl: gnu lesser general public licen[cs]e
3 lesser lgpl: lesser general public licen[cs]e
3 library lgpl: gnu library general public licen[cs]e
3 lgpl lgpl: lgpl( licen[cs]ed?)?
3 affero agpl: gnu affero general public licen[cs]e
3 affero agpl: affero general public licen[cs]e
3 agpl agpl: agpl( licen[cs]ed?)?
3 documentation gfdl: free documentation licen[cs]e
3 bsd bsd: bsd( style)? licen[cs]ed?
3 isc isc: isc licen[cs]ed?
3 mozilla mpl: mozilla public licen[cs]e
3 eclipse epl: eclipse public licen[cs]e
3 zlib zlib: zlib( libpng)? licen[cs]ed?
3 libpng libpng: libpng licen[cs]e
3 unlicense unlicense: unlicense( org)?
3 artistic artistic: artistic licen[cs]e
3 ruby ruby: ruby licen[cs]e
3 vim vim: vim licen[cs]e
3 curl curl: curl licen[cs]e
3 openssl openssl: openssl licen[cs]e
3 postgresql postgresql: postgresql licen[cs]e
3 ncsa ncsa: (ncsa|illinois)( ncsa)? open source licen[cs]e
3 unicode unicode: unicode licen[cs]e( agreement)?
3 w3c w3c: w3c software( notice and)?( and)?( document)? licen[cs]e
3 sleepycat sleepycat: sleepycat licen[cs]e
3 qt qpl-1.0: (q|qt) public licen[cs]e
3 free fal-1.3: free art licen[cs]e
3 beerware beerware: beerware( licen[cs]e)?
3 ware beerware: beer ware licen[cs]e
3 commons creative-commons: creative commons( licen[cs]e)?
3 domain public-domain: public domain( dedication)?
4 rights all-rights-reserved: all rights reserved
4 copyright copyright: copyright( c)? (19|20)[0-9][0-9]
4 copyrighted copyright: copyrighted (material|work)
4 licensed license-reference: licensed under( the| an?)? [^ ]+
4 released license-reference: released under( the| an?)? [^ ]+( [^ ]+){0,2} licen[cs]e
4 distributed license-reference: distributed under( the| an?)?( terms of( the)?)? [^ ]+( [^ ]+){0,2} licen[cs]e
4 available license-reference: available under( the| an?)?( terms of( the)?)? [^ ]+( [^ ]+){0,2} licen[cs]e
4 published license-reference: published under( the| an?)? [^ ]+( [^ ]+){0,2} licen[cs]e
4 terms license-reference: terms( and conditions)? of (this|the) licen[cs]e
4 agreement license-reference: end user licen[cs]e agreement
4 agreement license-reference: software licen[cs]e agreement
4 dual dual-license: dual licen[cs]ed
4 warranty warranty-disclaimer: without warranty of any kind
4 warranty warranty-disclaimer: without any warranty
4 warranties warranty-disclaimer: without warranties or conditions of any kind
4 proprietary proprietary: proprietary (licen[cs]e|software)
4 permission permission-required: (used|reprinted|reproduced) (with|by) permission
4 commercial non-commercial: non commercial (use|purposes) only
4 personal non-commercial: personal use only
"""
