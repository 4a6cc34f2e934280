"""Names and identifiers of licenses, and token automata against regular expressions over words."""

import random
import re

import pytest

from keyloom.llm import license

AUTOMATA = [license.Automaton(t) for _, _, t in license.TEMPLATES]


@pytest.mark.parametrize(("text", "labels"), [
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa"),
    ("Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa"),
    ("Creative Commons Attribution-NoDerivatives", "cc-by-nd"),
    ("Attribution-NonCommercial-NoDerivs 3.0", "cc-by-nc-nd"),
    ("GNU Lesser General Public License Version 3", "lgpl"),
    ("GNU General Public License v3.0", "gpl"),
    ("the GNU Affero General Public License", "agpl"),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
    ("SPDX-License-Identifier: (MIT OR ISC) AND BSD-3-Clause", "bsd-3,isc,mit"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl"),
    ("cc by nc sa", "cc-by-nc,cc-by-nc-sa"),  # the base phrase stays
    ("attribution of the words", ""),
])
def test_names(text, labels):
    assert license.scan(text, AUTOMATA)[5] == labels


def pattern(template):
    out = ""
    for n, part in enumerate(license.MARK.split(template)):
        if n % 2 == 0:
            out += "".join(w + " " for w in license.words(part))
        elif part.endswith("opt"):
            out += ")?" if part[0] == "/" else "(?:"
        else:
            least, most = part[4:].split("-")
            out += rf"(?:\S+ ){{{least},{most}}}"
    return re.compile(r"(?<!\S)" + out)


def test_automata_accept_what_regular_expressions_do():
    r = random.Random(9)
    patterns = [pattern(t) for _, _, t in license.TEMPLATES]
    for _ in range(200):
        ws = []
        for _ in range(4):
            some = license.words(license.MARK.sub(lambda m: r.choice([" ", " filler "]), r.choice(license.TEMPLATES)[2]))
            if len(some) > 3 and r.random() < 0.4:
                some[r.randrange(len(some))] = "other"
            ws += some
        text = " ".join(ws) + " "
        for a, p in zip(AUTOMATA, patterns):
            places = [i for i in range(len(ws)) if a.match(ws, i) >= 0]
            begins = {sum(len(w) + 1 for w in ws[:i]): i for i in range(len(ws))}
            assert places == [i for at, i in begins.items() if p.match(text, at)]
