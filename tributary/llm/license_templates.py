"""Licence wording as templates in markup, one per label.

``<<beginOptional>> ... <<endOptional>>`` may be left out (and nests); ``<<var;words=a-b>>`` stands for a to b words of
any kind. All other wording is mandatory. Case, punctuation and spacing do not count, as texts are compared by words.
"""

from __future__ import annotations

# The phrases and labels that the contract names.
BASE = [
    ("mit", "MIT License"),
    ("apache", "Apache License"),
    ("gpl", "General Public License"),
]

# Public licence texts and notices.
TEMPLATES = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words=1-6>> and associated
        documentation <<beginOptional>>files<<endOptional>> (the "<<var;words=1-2>>"), to deal in the <<var;words=1-2>> without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the <<var;words=1-2>>, and to permit persons to whom the <<var;words=1-2>> is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
        included in all copies or substantial portions of the <<var;words=1-2>>.
        <<beginOptional>>THE <<var;words=1-2>> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<var;words=1-2>>. IN NO EVENT SHALL
        <<var;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH <<var;words=1-3>> OR THE USE OR OTHER DEALINGS IN <<var;words=1-3>>.<<endOptional>>""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<var;words=0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. <<var;words=0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<var;words=0-1>> Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. <<var;words=0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<var;words=0-1>> Neither the name of <<var;words=1-12>> nor the names of <<beginOptional>>its<<endOptional>> contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
    ),
    (
        "apache-2.0",
        """Apache License, Version 2.0 <<beginOptional>>(the "License"); you may not use this
        <<var;words=1-3>> except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>>http<<beginOptional>>s<<endOptional>>://www.apache.org/licenses/LICENSE-2.0<<endOptional>><<endOptional>>""",
    ),
    (
        "gpl-2.0",
        """GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>,
        <<beginOptional>>either<<endOptional>> version 2 <<beginOptional>>of the License, or (at your option) any later version<<endOptional>>""",
    ),
    (
        "gpl-3.0",
        """GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>,
        <<beginOptional>>either<<endOptional>> version 3 <<beginOptional>>of the License, or (at your option) any later version<<endOptional>>""",
    ),
    (
        "lgpl",
        """GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Library<<endOptional>> General Public License
        <<var;words=0-8>> version 2 <<beginOptional>>1<<endOptional>> of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful""",
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        <<beginOptional>>If a copy of the MPL was not distributed with this file, You can obtain one at
        http<<beginOptional>>s<<endOptional>>://mozilla.org/MPL/2.0/<<endOptional>>""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the
        <<var;words=1-4>> be held liable for any damages arising from the use of this software.""",
    ),
    ("cc-by-nc", "<<beginOptional>>licensed under<<endOptional>> CC BY-NC <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by-sa", "<<beginOptional>>licensed under<<endOptional>> CC BY-SA <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by", "<<beginOptional>>licensed under<<endOptional>> CC BY 4.0"),
    ("cc0", "<<beginOptional>>licensed under<<endOptional>> CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
    (
        "cc-by",
        """Creative Commons Attribution <<beginOptional>>4.0<<endOptional>> <<beginOptional>>International<<endOptional>>
        <<beginOptional>>Public<<endOptional>> License""",
    ),
]
