from __future__ import annotations

import textwrap

from corpus_helpers import rows

from swellworks.llm import licenses as lic


def test_every_template_is_found_alone():
    for name, text in lic.TEMPLATES.items():
        found = lic.scan("An intro line.\n" + text + "\nmore text")
        assert [m.license for m in found] == [name] and found[0].missing == () == found[0].extra


def test_wording_differences_decide():
    mit = lic.TEMPLATES["MIT"]
    changed = lic.scan(mit.replace("without restriction", "with no restriction at all"))
    assert changed[0].license == "MIT" and "without" in changed[0].missing and "no" in changed[0].extra
    assert lic.scan("Released under the Foo License.") == [] and lic.scan("My driving license expired.") == [] and lic.scan(None) == []
    both = lic.scan(lic.TEMPLATES["MIT-notice"] + "\n\n" + lic.TEMPLATES["GPL-3.0-notice"])
    assert [m.license for m in both] == ["MIT-notice", "GPL-3.0-notice"]


def test_long_single_line_is_covered():
    text = "license word " + "filler " * 3000 + lic.TEMPLATES["ISC"] + " filler" * 3000
    assert [m.license for m in lic.scan(text)] == ["ISC"]


def test_query_against_plain_search(documents, odd, empty):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0-notice", "Released under the MIT License.": "MIT-notice"}
    want = sorted((r.doc_id, sorted(v for k, v in lines.items() if k in (r.text or ""))) for r in documents.collect())
    assert sorted((r.doc_id, r.licenses) for r in lic.licenses(documents).collect()) == want
    assert len(rows(lic.licenses(odd))) == odd.count() and lic.licenses(empty).count() == 0


#: As published: several paragraphs, list items, lines of some 75 characters.
PUBLISHED = {
    "MIT": """MIT License

Copyright (c) 2020 Ann Other

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "Apache-2.0": """Copyright 2020 Ann Other

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "BSD-3-Clause": """Copyright (c) 2020, Ann Other
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "ISC": """Copyright (c) 2020 Ann Other

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
}


def test_published_layouts_and_comment_signs():
    for name, text in PUBLISHED.items():
        for sign in ("", " * ", "# ", "// "):
            body = "\n".join(sign + x for x in text.split("\n"))
            assert [m.license for m in lic.scan(f"An intro.\n\n{body}\n\nFiller ends here.\n" * 2)] == [name] * 2, (name, sign)
    first = PUBLISHED["GPL-3.0-or-later"].split("\n\n")[0]
    assert lic.scan(first) == [] and [m.license for m in lic.scan(first.replace("version 3", "version 2"))] == ["GPL-2.0-or-later"]


def test_all_notices_of_a_block_are_confirmed():
    short = [n for n, t in lic.TEMPLATES.items() if len(lic.words(t)) <= 12]
    assert len(short) > 5
    for sep in ("\n", " ", "\n\n"):
        assert [m.license for m in lic.scan(sep.join(lic.TEMPLATES[n] for n in short))] == short
    assert [m.license for m in lic.scan("\n".join(lic.TEMPLATES.values()))] == list(lic.TEMPLATES)
    assert [m.license for m in lic.scan("\n\n".join(PUBLISHED.values()))] == list(PUBLISHED)


def test_every_template_at_every_width():
    """Wrapped at 30 to 100 columns under a copyright line, hyphens at line ends too: found, and no word is missing."""
    for name, text in lic.TEMPLATES.items():
        for width in range(30, 101):
            lines = textwrap.wrap(text, width, break_long_words=False)
            for sign in ("", " * "):
                body = "\n".join(sign + x for x in ["Copyright (c) 2020 Ann Other", "", *lines])
                got = lic.scan(f"Words before.\n{body}\nWords after.\n")
                assert [(m.license, m.missing) for m in got] == [(name, ())], (name, width, sign)
