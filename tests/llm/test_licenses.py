"""License notices: altered wording, full texts, many notices in one text, and a version that skips no template."""

import time

import numpy as np
import pytest

from loomspark.llm import licenses

PROSE = "while many members spoke about roads bridges water quality budget plans next year several questions remained open after lunch when guests arrived from nearby towns bringing cheerful news".split()


def plain_version(text):
    """Every trigger and every template, without looking at naming words first."""
    alone, groups, _ = licenses.prepared()
    words = licenses._words(text)
    found, done = [], 0
    for m in licenses.TRIGGER.finditer(text):
        at = max(i for i, w in enumerate(words) if w[1] <= m.start())
        options = []
        for around, own in groups:
            part = words[max(done, at - around) : at + around + 1] if at >= done else []
            for t in own if part else []:
                raw = " ".join(w for w, _, _ in part).encode()
                place = licenses.worded([w for w, _, _ in part], t)
                if place and part[place[0]][1] <= words[at][1] < part[place[1] - 1][2]:
                    options.append((len(t.compressor.compress(raw)) - len(alone.compress(raw)), t.name, part[place[0]], part[place[1] - 1]))
        if options:
            _, name, first, last = min(options, key=lambda o: o[:2])
            found.append((name, first[1], last[2]))
            done = words.index(last) + 1
    return found


def test_against_a_version_that_skips_nothing():
    rng = np.random.default_rng(4)
    notices = [t for t, _ in licenses.TEMPLATES.values()]
    for _ in range(25):
        parts = []
        for _ in range(rng.integers(1, 6)):
            notice = rng.choice(notices).split()
            for _ in range(rng.integers(0, 3)):  # drop, put in or change a word
                k = rng.integers(0, len(notice))
                notice = [notice[:k] + notice[k + 1 :], notice[:k] + [rng.choice(PROSE)] + notice[k:], notice[:k] + ["license"] + notice[k + 1 :]][rng.integers(0, 3)]
            parts += [" ".join(notice), " ".join(rng.choice(PROSE, rng.integers(0, 30)))]
        text = "\n".join(parts)
        assert [(f[1], f[2], f[3]) for f in licenses.findings(text)] == plain_version(text)


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_template_broken_into_lines_between_prose(name):
    before, after = " ".join(PROSE[:9]), " ".join(PROSE[9:])
    words = licenses.TEMPLATES[name][0].split()
    notice = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
    found = licenses.findings(f"{before}.\n\n{notice.upper() if len(words) > 5 else notice}\n\n{after}")
    assert [f[1] for f in found] == [name] and found[0][2] == len(before) + 3 and found[0][5] == "" and found[0][6] == 0


def test_differences_of_wording():
    (f,) = licenses.findings("This text is distributed under the MIT License.")
    assert (f[0], f[5], f[6]) == ("MIT", "released", 0)
    (f,) = licenses.findings("This program, a toy, is free software: you can redistribute it or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.")
    assert f[1] == "GPL:header" and {"and"} <= set(f[5].split()) and f[6] == 2
    assert licenses.findings("Licensed under the GNU Public License of the board, version nine.") == []
    assert licenses.findings("The MIT faculty said a license to fish was released") == []


def test_one_megabyte_of_notices():
    few = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: MIT", "Licensed under the Apache License, Version 2.0."]
    text = " ".join(few * (1_000_000 // len(" ".join(few))))
    began = time.process_time()
    found = licenses.findings(text)
    assert len(found) == len(few) * (1_000_000 // len(" ".join(few))) and time.process_time() - began < 20
    began = time.process_time()
    licenses.findings("license permission redistribute " * 30_000)
    assert time.process_time() - began < 20
