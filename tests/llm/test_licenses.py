import textwrap

import pytest

from tamis.llm import licenses

# Official wordings.
MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
HOLDER = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "    http://www.apache.org/licenses/LICENSE-2.0",
)
GPL = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{1} either version {2} of the License, or (at your option) any later version."
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
OFFICIAL = {
    "MIT": MIT,
    "BSD-2-Clause": BSD,
    "BSD-3-Clause": (*BSD, HOLDER.format("the copyright holder")),
    "BSD-3-Clause ": (*BSD, HOLDER.format("Google Inc.")),
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": (GPL.format(":", ",", 3), HOPE),
    "GPL-2.0-or-later": (GPL.format(";", ";", 2), HOPE),
    "MPL-2.0": (MPL,),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("lead", ["", " * ", "# ", "// "])
def test_official_texts_in_any_width(spark, docs_of, lead, end):
    rows, want = [], {}
    for name, paragraphs in OFFICIAL.items():
        for width in (70, 72, 76, 80, 10_000):
            lines = [lead + "Copyright (c) 2020 Somebody", lead.rstrip()]
            for p in paragraphs:
                lines += [lead + x for x in textwrap.wrap(p, width - len(lead))] + [lead.rstrip()]
            want[len(rows)] = [name.strip()]
            rows.append((len(rows), end.join(lines)))
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(rows)).collect()}
    assert got == want


def test_what_is_no_known_sentence(spark, docs_of):
    rows = [
        (1, "We were never released under the MIT License."),
        (2, "Released under the MIT\n\nLicense"),
        (3, "Released under the MIT Licensee"),
        (4, "This work is licensed under the GNU General Public License, version 3 or (at\nyour option) any later version."),
        (5, "license " + "! " * 200_000 + "\t\n" * 200_000 + "Licensed\nunder CC0 1.0"),
        (6, "license " + "\u65e5" * 500_000 + "\nReleased under the MIT License"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(rows)).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [], 5: ["CC0-1.0"], 6: ["MIT"]}


def test_rules(spark, docs_of):
    mit = (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.\n'
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    )
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    )
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore text."),
        (2, mit),
        (3, bsd + "\nLicensed under CC BY-NC 4.0."),
        (4, "mentions the MIT License and a licence fee but has no licence sentence"),
        (5, None),
        (6, ""),
        (7, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
        (None, "This work is licensed under the GNU General Public License, version 3."),
        (1, "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."),
        (8, "word " * 30_000 + "\nReleased under the MIT License."),
    ]
    got = sorted(((r.doc_id or -1), r.licenses, r.classes) for r in licenses.scan(docs_of(rows)).collect())
    assert got == [
        (-1, ["GPL-3.0"], ["copyleft"]),
        (1, ["Apache-2.0", "Apache-2.0"], ["permissive"]),
        (1, ["MIT"], ["permissive"]),
        (2, ["MIT"], ["permissive"]),
        (3, ["BSD-2-Clause", "CC-BY-NC-4.0"], ["non-commercial", "permissive"]),
        (4, [], []),
        (5, [], []),
        (6, [], []),
        (7, ["Apache-2.0"], ["permissive"]),
        (8, ["MIT"], ["permissive"]),
    ]
    assert licenses.scan(docs_of([])).count() == 0


def test_rules_name_known_sentences():
    assert all(letter in licenses.SENTENCES for needs, _, _ in licenses.RULES for letter in needs)
    assert all(len(k) == 1 for k in licenses.SENTENCES)
