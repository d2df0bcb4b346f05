"""Wordings of public licenses in template markup (fixed values, read by ``licenses.py``).

``<<beginOptional>> ... <<endOptional>>`` may be left out, ``<<var;name="..";words="0-20">>`` stands for any words (so
many at least and at most) and ``<<var;name="..";match="a|b c">>`` for one of some wordings. Case and punctuation do
not count.
"""

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_UNDER = '<<var;name="verb";match="licensed|released|distributed|available|provided|made available|published">> under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>>'
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;name="holder";words="1-20">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL <<var;name="holder";words="1-20">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>>
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

#: Label -> template.
TEMPLATES = {
    "mit-notice": _UNDER + " MIT License",
    "apache-2.0-notice": _UNDER + " Apache License <<beginOptional>>Version<<endOptional>> 2.0",
    "gpl-2.0-notice": _UNDER + " GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    "gpl-3.0-notice": _UNDER + " GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "lgpl-notice": _UNDER + ' GNU <<var;name="kind";match="Lesser|Library">> General Public License',
    "cc-by-4.0-notice": _UNDER + ' <<var;name="name";match="CC BY|Creative Commons Attribution">> 4.0',
    "cc-by-sa-4.0-notice": _UNDER + ' <<var;name="name";match="CC BY-SA|Creative Commons Attribution-ShareAlike">> 4.0',
    "cc-by-nc-4.0-notice": _UNDER + ' <<var;name="name";match="CC BY-NC|Creative Commons Attribution-NonCommercial">> 4.0',
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";words="1-20">> BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND <<var;name="holder";words="1-20">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";words="1-20">>
BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": f"{_REDISTRIBUTION} {_DISCLAIMER}",
    "bsd-3-clause-text": f"""{_REDISTRIBUTION} <<beginOptional>>3<<endOptional>> Neither the name of
<<var;name="organization";words="1-20">> nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. {_DISCLAIMER}""",
    "apache-2.0-text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
<<var;name="address";words="1-12">> Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-text": """This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the
terms of the GNU General Public License as published by the Free Software Foundation<<beginOptional>>, either<<endOptional>> version
<<var;name="version";match="2|3">> of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will
<<var;name="holder";words="1-20">> be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions""",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
}
