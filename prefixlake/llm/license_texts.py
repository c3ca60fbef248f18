"""Names and standard texts of licence families, and sentences that speak of licences and grant none of these."""

from __future__ import annotations

#: Names that stand in short notices, by family; versions are written ``#``, as all numbers are.
NAMES = {
    "apache": ("apache license version #", "apache license #", "apache # license", "apache software license", "apache license"),
    "mit": ("mit license", "expat license", "x11 license"),
    "bsd": ("bsd license", "bsd # clause license", "bsd # clause", "new bsd license", "simplified bsd license", "modified bsd license"),
    "gpl": ("gnu general public license version #", "gnu general public license", "gnu gpl", "gpl version #", "gpl v#"),
    "lgpl": ("gnu lesser general public license version #", "gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl version #"),
    "agpl": ("gnu affero general public license version #", "gnu affero general public license", "affero general public license", "gnu agpl", "agpl version #"),
    "mpl": ("mozilla public license version #", "mozilla public license", "mozilla public license v #", "mpl version #"),
    "epl": ("eclipse public license version #", "eclipse public license", "eclipse public license v #", "epl version #"),
    "cddl": ("common development and distribution license", "cddl version #"),
    "eupl": ("european union public licence", "european union public license", "eupl version #"),
    "isc": ("isc license", "internet systems consortium license"),
    "boost": ("boost software license version #", "boost software license"),
    "zlib": ("zlib license", "zlib libpng license"),
    "unlicense": ("the unlicense", "released into the public domain"),
    "wtfpl": ("do what the fuck you want to public license",),
    "artistic": ("artistic license #", "artistic license", "perl artistic license"),
    "ofl": ("sil open font license version #", "sil open font license", "open font license"),
    "postgresql": ("postgresql license", "postgresql licence"),
    "cc0": ("cc0 # universal", "creative commons zero", "creative commons cc0", "cc0 public domain dedication"),
    "cc-by": ("cc by #", "creative commons attribution # international license", "creative commons attribution license", "creative commons attribution #"),
    "cc-by-sa": ("cc by sa #", "cc by sa", "creative commons attribution sharealike # international license", "creative commons attribution sharealike license", "creative commons attribution share alike license", "creative commons attribution sharealike #"),
    "cc-by-nd": ("cc by nd #", "cc by nd", "creative commons attribution noderivatives # international license", "creative commons attribution noderivatives license", "creative commons attribution no derivatives license", "creative commons attribution noderivatives #"),
    "cc-by-nc": ("cc by nc #", "cc by nc", "creative commons attribution noncommercial # international license", "creative commons attribution noncommercial license", "creative commons attribution non commercial license", "creative commons attribution noncommercial #"),
    "cc-by-nc-sa": ("cc by nc sa #", "cc by nc sa", "creative commons attribution noncommercial sharealike # international license", "creative commons attribution noncommercial sharealike license", "creative commons attribution noncommercial sharealike #"),
    "cc-by-nc-nd": ("cc by nc nd #", "cc by nc nd", "creative commons attribution noncommercial noderivatives # international license", "creative commons attribution noncommercial noderivatives license", "creative commons attribution noncommercial noderivatives #"),
}
#: Names of one word, which count only behind these words or before them.
SHORT = {"apache": "apache", "mit": "mit", "bsd": "bsd", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "cddl": "cddl", "eupl": "eupl", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "wtfpl": "wtfpl", "ofl": "ofl", "cc0": "cc0"}
BESIDE = ("identifier {}", "identifier {} #", "identifier {} # or later", "identifier {} # only", "license {}", "under {}", "under the {}", "{} lizenz", "licence {}", "licencia {}", "{} licensed")
#: How short notices begin.
LEADS = (
    "licensed under the", "released under the", "distributed under the terms of the", "available under the", "provided under the", "published under the", "this work is licensed under the", "this software is licensed under the",
    "subject to the terms of the", "covered by the", "use of this source code is governed by the", "licensed under a", "licensed under", "released under", "spdx license identifier", "license", "made available under the", "this file is part of a project under the",
    "veröffentlicht unter der", "lizenziert unter der", "publié sous la", "sous licence", "publicado bajo la", "bajo la licencia",
)

#: Standard texts: the paragraphs that notices and licence files hold.
BODIES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http www gnu org licenses",
        "GNU GENERAL PUBLIC LICENSE Version 3 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",
    ),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https www eclipse org legal epl 2.0",),
    "cddl": ("The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License. When distributing Covered Code, include this CDDL HEADER in each file",),
    "eupl": ("Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http www boost org LICENSE 1 0 txt",
    ),
    "zlib": (
        "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "wtfpl": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION You just DO WHAT THE FUCK YOU WANT TO.",),
    "artistic": ("This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License. The Package may be redistributed under the conditions of the Artistic License, and the Copyright Holder maintains artistic control over the development of that Package",),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is available with a FAQ at http scripts sil org OFL",),
    "postgresql": ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",),
    "cc0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",),
    "cc-by": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http creativecommons org licenses by 4.0",),
    "cc-by-sa": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http creativecommons org licenses by sa 4.0",),
    "cc-by-nd": ("This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http creativecommons org licenses by nd 4.0",),
    "cc-by-nc": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http creativecommons org licenses by nc 4.0",),
    "cc-by-nc-sa": ("This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy of this license, visit http creativecommons org licenses by nc sa 4.0",),
    "cc-by-nc-nd": ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License. To view a copy of this license, visit http creativecommons org licenses by nc nd 4.0",),
}
#: Texts of other licences, and sentences about licences: the first group is learned, the second held back for calibration.
UNKNOWN = (
    "All rights reserved. No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
    "This software is licensed under a commercial agreement and may be used only by the licensee.", "The license fee is due each year on the first of March.", "See the license file for details.", "Contact us for a license.",
    "A license is needed to drive a car.", "The driver had no license with him when the police came.", "The general public may enter free of charge.", "Licensed under terms to be announced.", "This code isn't licensed under any open license.",
    "The code is not licensed under the {name}.", "It is no longer licensed under the {name}.", "It was never released under the {name}.", "We compare the {name} with other licenses in this chapter.", "Unlike the {name}, this agreement forbids redistribution.",
    "Permission was granted to the visitors by the council.", "He asked for permission to copy the painting.", "Copyright of the author, used with permission.", "End user license agreement: by installing the product you accept the terms of this agreement.",
    "You may not rent, lease, lend, sell, redistribute or sublicense the licensed application.", "The licensor grants you a nonexclusive license to use the software on one computer.", "The university gave a master of science degree at the mit campus.", "An apache helicopter landed near the boost station.",
    "Er kam mit dem Zug und fuhr mit der Lizenz zum Angeln heim.", "Le permis et la licence sont à la maison.", "La licencia de conducir está en la mesa.", "Source code and binary numbers are explained below.", "The software is provided to customers with a warranty of two years.",
    "This document is confidential and may be used only under the terms of a non disclosure agreement.", "The gnu grazed by the river while the eclipse began.", "The public license plate was stolen from the car.", "Her artistic license in the novel was wide.",
    "Mozilla published a new version of the browser.", "Creative people met on the commons for a picnic.", "The attribution of the painting to the master is in doubt.", "Free software is a matter of liberty, said the speaker.", "The warranties of the seller are limited by law.",
)
HELD_BACK = (
    "Licensed under the Server Side Public License, version 1.", "Business Source License 1.1, the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non production use of the licensed work.", "Licensed under the Elastic License 2.0.",
    "Python Software Foundation License Version 2", "Licensed under Mulan PSL v2.", "The Software shall be used for Good, not Evil.", "This product includes software developed by the OpenSSL Project for use in the toolkit.", "Licensed under the Microsoft Reference Source License.",
    "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.", "The fishing license costs ten dollars and permits two fish.", "The licensee shall pay the licensor a fee for each copy distributed.",
    "Copyright the contributors, see the notice in the distribution for conditions.", "The court held that permission to distribute copies had not been given.", "Terms of use: you agree not to modify, publish or sell content of this site.", "The bar lost its liquor license.", "Mit freundlichen Grüßen, die Lizenz folgt.",
    "Open Database License, share, create and adapt the database", "Licensed under the Open Government Licence.", "The library is open to any person with a card.", "A bureau of software standards was created by law.",
)
