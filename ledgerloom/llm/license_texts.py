"""The templates of the license scan: whole bodies, standard headers, and short declarations.

Fixed values: the words of the licenses. A short declaration names the words that it cannot do
without, which tell its license from others.
"""

BODIES = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
        "and to permit third-parties to whom the Software is furnished to do so",
    ),
    (
        "WTFPL",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
        "changing it is allowed as long as the name is changed.",
    ),
    (
        "Warranty-Disclaimer",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
)

_GNU = (
    "{}: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software "
    "Foundation, either version {} of the License, or (at your option) any later version."
)

HEADERS = (
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", _GNU.format("This program is free software", "General Public License", 3)),
    ("GPL-2.0", _GNU.format("This program is free software; ", "General Public License", 2)),
    ("LGPL-3.0", _GNU.format("This library is free software", "Lesser General Public License", 3)),
    ("LGPL-2.1", _GNU.format("This library is free software; ", "Lesser General Public License", "2.1")),
    ("AGPL-3.0", _GNU.format("This program is free software", "Affero General Public License", 3)),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "CC-BY-4.0",
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of "
        "this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view "
        "a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work. This work is dedicated to the public domain under CC0 1.0 Universal.",
    ),
)

# How a license is declared, and the names by which it is called there.
DECLARATIONS = ("released under the {} license", "licensed under the {} license", "licensed under {}", "under the terms of the {} license")
TELLING = ("licensed", "released", "license", "terms")
NAMES = (
    ("MIT", "MIT"),
    ("Apache-2.0", "Apache 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("BSD", "BSD"),
    ("BSD-2-Clause", "BSD 2 Clause"),
    ("BSD-3-Clause", "BSD 3 Clause"),
    ("ISC", "ISC"),
    ("Zlib", "zlib"),
    ("GPL-2.0", "GPL 2.0"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GPL 3.0"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY NC SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY NC ND 4.0"),
)
# Said in few words, all of which are needed.
PHRASES = (
    ("All-Rights-Reserved", "all rights reserved"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Public-Domain", "dedicated to the public domain"),
)
# Headings, which stand in a line of their own; and identifiers behind ``SPDX-License-Identifier``.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
)
