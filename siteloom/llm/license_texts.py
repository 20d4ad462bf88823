"""Public licence notices and statements, by family: what the scanner is trained from.

``{v}`` stands for a version or a year.  ``HELD_OUT`` are wordings of the same
families that are not trained from but calibrate; ``OTHERS`` and
``OTHERS_HELD_OUT`` are statements of licences of no family here, and prose
about the same words, for the unknown class.
"""

TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "licensed under the apache license, version {v}.",
        "released under the apache license {v}",
        "spdx-license-identifier: apache-{v}",
        "distributed under the terms of the apache software license version {v}",
        'licensed under the apache license, version {v} (the "license"); you may not use this file except in compliance with the license. '
        "you may obtain a copy of the license at http://www.apache.org/licenses/license-{v} "
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "
        '"as is" basis, without warranties or conditions of any kind, either express or implied. '
        "see the license for the specific language governing permissions and limitations under the license.",
        "licensed to the apache software foundation (asf) under one or more contributor license agreements. "
        "see the notice file distributed with this work for additional information regarding copyright ownership.",
    ],
    "boost": [
        "distributed under the boost software license, version {v}.",
        "boost software license - version {v}",
        "spdx-license-identifier: bsl-{v}",
        "use, modification and distribution are subject to the boost software license, version {v}. (see accompanying file license_1_0.txt)",
        "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "software") to use, reproduce, display, distribute, execute, and transmit the software, '
        "and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so",
    ],
    "bsd": [
        "released under the bsd license.",
        "licensed under the {v}-clause bsd license",
        "this code is distributed under the new bsd license",
        "spdx-license-identifier: bsd-{v}-clause",
        "use of this source code is governed by a bsd-style license that can be found in the license file.",
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission.",
        'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but '
        "not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall "
        "the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages",
    ],
    "cc": [
        "licensed under cc by-nc {v}.",
        "licensed under cc by {v}.",
        "licensed under cc by-sa {v}.",
        "spdx-license-identifier: cc-by-{v}",
        "this work is licensed under a creative commons attribution {v} international license.",
        "this work is licensed under the creative commons attribution-sharealike {v} unported license. to view a copy of this license, "
        "visit http://creativecommons.org/licenses/by-sa/{v}/ or send a letter to creative commons, po box 1866, mountain view, ca 94042, usa.",
        "available under the creative commons attribution-noncommercial license {v}",
        "released under cc0 {v} public domain dedication",
        "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. creative commons cc0",
    ],
    "epl": [
        "eclipse public license - v {v}",
        "licensed under the eclipse public license, version {v}",
        "spdx-license-identifier: epl-{v}",
        "this program and the accompanying materials are made available under the terms of the eclipse public license v{v} which accompanies "
        "this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license, version {v}.",
        "licensed under the gpl, version {v} or later",
        "released under the gnu lesser general public license v{v}",
        "gnu affero general public license version {v}",
        "spdx-license-identifier: gpl-{v}-or-later",
        "spdx-license-identifier: lgpl-{v}-only",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as "
        "published by the free software foundation, either version {v} of the license, or (at your option) any later version.",
        "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of "
        "merchantability or fitness for a particular purpose. see the gnu general public license for more details. you should have received "
        "a copy of the gnu general public license along with this program. if not, see <https://www.gnu.org/licenses/>.",
    ],
    "isc": [
        "released under the isc license",
        "spdx-license-identifier: isc",
        "licensed under the terms of the isc license.",
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. the software is provided \"as is\" and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    ],
    "mit": [
        "released under the mit license.",
        "licensed under the mit license",
        "this project is distributed under the terms of the mit license",
        "spdx-license-identifier: mit",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "software"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do "
        "so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software.",
        'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of '
        "merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable "
        "for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection "
        "with the software or the use or other dealings in the software.",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license, v. {v}. if a copy of the mpl was not distributed with "
        "this file, you can obtain one at http://mozilla.org/mpl/{v}/.",
        "licensed under the mozilla public license version {v}",
        "released under mpl {v}",
        "spdx-license-identifier: mpl-{v}",
    ],
    "proprietary": [
        "all rights reserved.",
        "copyright {v}. all rights reserved. unauthorized copying of this file, via any medium, is strictly prohibited. proprietary and confidential.",
        "no part of this publication may be reproduced, distributed or transmitted in any form without prior written permission of the publisher",
    ],
    "unlicense": [
        "released under the unlicense",
        "spdx-license-identifier: unlicense",
        "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial.",
    ],
    "zlib": [
        "licensed under the zlib license",
        "spdx-license-identifier: zlib",
        "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages "
        "arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: the origin of this software must not "
        "be misrepresented; altered source versions must be plainly marked as such; this notice may not be removed or altered from any source distribution.",
    ],
}

HELD_OUT: dict[str, list[str]] = {
    "apache": ["this software is distributed under the apache license, version {v}", "the project is available under the apache {v} license"],
    "boost": ["this library is subject to the boost software license, version {v}"],
    "bsd": ["this library is released under the {v}-clause bsd license", "available under a bsd license"],
    "cc": ["the text of this page is under the creative commons attribution-sharealike license {v}", "content on this site is licensed under cc by {v}"],
    "epl": ["this plug-in is available under the eclipse public license {v}"],
    "gpl": ["this library is licensed under the terms of the gnu lesser general public license, version {v}", "available under the gnu gpl version {v}"],
    "isc": ["this package is under the isc license"],
    "mit": ["this library is made available under the mit license", "code is under the mit license"],
    "mpl": ["this file is made available under the mozilla public license {v}"],
    "proprietary": ["copyright {v} the authors. all rights reserved."],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib": ["this code is available under the zlib license"],
}

OTHERS: list[str] = [
    "licensed under the european union public licence, version {v}",
    "licensed under the common development and distribution license version {v}",
    "released under the sil open font license {v}",
    "licensed under the academic free license {v}",
    "you may use this software under the terms of your agreement with the vendor",
    "the license of the driver was taken by the police",
    "a public library is open to the general public",
    "the apache helicopter flew over the valley",
    "she studied at mit for three years",
    "the project was released under great pressure",
    "all of the rights that people have",
    "permission to enter was granted at noon",
    "version two of the software is free to use on the weekend",
    "your rights under the contract are limited",
    "the warranty covers parts and labour for two years",
    "a copy of the notice was sent to each holder of a ticket",
    "the boost to the software trade was welcome",
    "an eclipse is a public event",
    "the licence fee rose again under the new terms",
]

OTHERS_HELD_OUT: list[str] = [
    "licensed under the eupl, version {v}",
    "released under the artistic license {v}",
    "this package is under the terms of the open software license {v}",
    "the licence to fish was granted under new conditions",
    "copies of the software were distributed to schools without charge",
    "your rights under the warranty are limited",
    "a person obtaining the permission must include the notice",
]

VERSIONS = ("1.0", "2.0", "2.1", "3", "3.0", "4.0")
