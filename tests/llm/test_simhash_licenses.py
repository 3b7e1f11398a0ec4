import math
import random
from collections import Counter

import numpy as np
import pytest
from cases import ODD, frame, with_clashes

from tokenwright.llm import kernel as K
from tokenwright.llm import licenses as L
from tokenwright.llm import simhash as H
from tokenwright.llm.licenses import ExpressionError, automaton, evaluate, license_scan, scan, to_postfix


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_all_pairs_within_the_radius(spark, radius):
    rnd = random.Random(radius)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        g = f
        for _ in range(rnd.randint(0, 6)):
            g ^= 1 << rnd.randrange(64)
        fps.add(g)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b): ((a ^ b) & (1 << 64) - 1).bit_count() for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
    got = H.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fingerprint long"), radius).collect()
    assert {(r.a, r.b): r.distance for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("blocks", [4, 6, 9])
def test_pairs_are_the_same_by_any_number_of_blocks(spark, blocks):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << k for k in rnd.sample(range(24), rnd.randint(0, 5))) for _ in range(120)}  # one hot key for blocks of low bits
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = [(r.a, r.b) for r in H.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fingerprint long"), 3, blocks).collect()]
    assert set(got) == want and len(got) == len(want)


def test_blocks_grow_with_the_table():
    numbers = [H.block_number(n, 3) for n in (10**3, 10**5, 10**8, 10**11)]
    assert numbers == sorted(numbers) and numbers[-1] > numbers[0]


def brute_fingerprint(text):
    """Votes by plain loops; only the hashes are the operator's."""
    data = np.frombuffer(text.encode(), np.uint8)
    _, _, h, woff = K.words(K.fold(data), np.array([0, len(data)]), K.NON_WORD)
    terms, _ = K.shingles(h, woff, H.TERM_WORDS)
    votes = [0.0] * 64
    for term, n in Counter(terms.tolist()).items():
        for bit in range(64):
            votes[bit] += (1 + math.log2(n)) * (1 if term >> bit & 1 else -1)
    f = sum(1 << bit for bit in range(64) if votes[bit] > 1e-4)
    unsure = sum(1 << bit for bit in range(64) if abs(votes[bit]) <= 1e-4)
    return f, unsure


def test_fingerprints_match_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["A", "b", "c", "dé", "E2"]) for _ in range(rnd.randint(1, 120)))) for i in range(40)]
    for r in H.fingerprints(frame(spark, rows)).collect():
        f, unsure = brute_fingerprint(dict(rows)[r.doc_id])
        assert (r.fingerprint & (1 << 64) - 1) & ~unsure == f & ~unsure


def test_near_texts_have_near_fingerprints(spark):
    rng = random.Random(0)
    base = [f"w{rng.randrange(500)}" for _ in range(600)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "changed"])), (3, " ".join(base)), (4, " ".join(f"v{i}" for i in range(400)))]
    of = {r.doc_id: r for r in H.near_documents(frame(spark, rows), radius=8).collect()}
    assert of[1].fingerprint == of[3].fingerprint and of[1].class_size == 2
    assert of[2].fingerprint == of[1].fingerprint or of[1].links == of[2].links == 1
    assert of[4].links == 0


def test_links_match_brute_force(spark):
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if rnd.random() > 0.01 else "x" for w in base) if i % 2 else " ".join(f"v{rnd.randrange(50)}" for _ in range(60))) for i in range(80)]
    got = H.near_documents(frame(spark, rows), radius=6).collect()
    fp = {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in got}
    for r in got:
        assert r.links == sum(0 < (f ^ fp[r.doc_id]).bit_count() <= 6 for f in set(fp.values()))
        assert r.class_size == sum(f == fp[r.doc_id] for f in fp.values())


def test_simhash_odd_rows(spark):
    got = H.near_documents(with_clashes(frame(spark, ODD))).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    assert {r.doc_id for r in got if r.fingerprint is None} == {1001, 1002, 1003, None} and all((r.class_size, r.links) == (None, 0) for r in got if r.fingerprint is None)
    assert [r.class_size for r in got if r.doc_id in (1005, 1006)] == [3, 3, 3]
    assert H.near_documents(frame(spark, [])).count() == 0


def test_votes():
    data = np.frombuffer(b"a b c", np.uint8)
    fp, has = H.simhash(data, np.array([0, 5, 5]))
    assert has.tolist() == [True, False] and fp[1] == 0


@pytest.mark.parametrize("text, form, rank", [
    ("MIT", "MIT", 1), ("mit or gpl-2.0-only", "MIT OR GPL-2.0-only", 1), ("MIT AND GPL-3.0-only OR ISC", "MIT AND GPL-3.0-only OR ISC", 1),
    ("MIT AND (GPL-3.0-only OR AGPL-3.0)", "MIT AND (GPL-3.0-only OR AGPL-3.0)", 3), ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", 2),
    ("GPL-2.0+ then ordinary text", "GPL-2.0+", 3), ("((MIT))", "MIT", 1),
])
def test_expressions(text, form, rank):
    assert evaluate(text)[:2] == (form, rank)


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "MIT WITH ISC", "Classpath-exception-2.0", "Own-Terms", "MIT AND ()"])
def test_bad_expressions(text):
    with pytest.raises(ExpressionError):
        evaluate(text)


def test_postfix():
    assert to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]


def test_scan(spark):
    auto = automaton()
    assert scan("x\n// SPDX-License-Identifier: MIT OR Apache-2.0 */\nRedistribution and use in source and binary forms", auto)[:2] == ("found", "BSD-3-Clause AND (MIT OR Apache-2.0)")
    assert scan("SPDX-License-Identifier: nonsense", auto)[0] == "invalid"
    assert scan("admit licensee", auto)[0] == "none" and scan("summit license", auto)[0] == "none"
    rows = [*ODD, (1, "y" * 300000 + "\nThis is under the MIT License.")]
    got = license_scan(with_clashes(frame(spark, rows))).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.status != "none"} == {1}
    assert license_scan(frame(spark, [])).count() == 0


GPL3 = """
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""


@pytest.mark.parametrize("text, expression, obligation", [
    (GPL3, "GPL-3.0-or-later", "copyleft"), (GPL3.replace("General", "Lesser General"), "LGPL-3.0-or-later", "weak-copyleft"), (GPL3.replace("General", "Affero General"), "AGPL-3.0-or-later", "network-copyleft"),
    ("under the GNU Lesser General  Public License as published by the\n# Free Software Foundation; either\n# version 2.1 of", "LGPL-2.1-or-later", "weak-copyleft"),
    ("// subject to the terms of the Mozilla Public\n// License, v. 2.0. If", "MPL-2.0", "weak-copyleft"), ("under  the MIT\n\n  License", "MIT", "permissive"),
    ("SPDX-License-Identifier: OFL-1.1 OR MIT", "OFL-1.1 OR MIT", "permissive"), ("SPDX-License-Identifier: OFL-9.1 OR MIT", "OFL-9.1 OR MIT", None), ("SPDX-License-Identifier: CC-BY-NC-4.0 AND LicenseRef-x", "CC-BY-NC-4.0 AND LicenseRef-x", "non-commercial"),
    ("SPDX-License-Identifier: GFDL-1.3-only", "GFDL-1.3-only", "copyleft"), ("SPDX-License-Identifier: GFDL-9.3-only", "GFDL-9.3-only", None), ("SPDX-License-Identifier: CC0-1.0 OR Own-Terms", "CC0-1.0 OR Own-Terms", "public-domain"),
    ("SPDX-License-Identifier: GPL-3.0-only WITH Some-exception-1.0", "GPL-3.0-only WITH Some-exception-1.0", None),
])
def test_wrapped_notices_and_unknown_identifiers(text, expression, obligation):
    got = scan(text, automaton())
    assert got[0] == "found" and got[1] == expression and got[3] == obligation and got[4] == 1


def test_words_that_are_no_identifiers():
    assert scan("SPDX-License-Identifier: MIT and so on", automaton())[0] == "invalid"


@pytest.mark.parametrize("text, expression, obligation", [
    ("SPDX-License-Identifier: AFL-3.0", "AFL-3.0", "permissive"), ("SPDX-License-Identifier: LicenseRef-Foo", "LicenseRef-Foo", None), ("SPDX-License-Identifier: CC-BY-ND-4.0", "CC-BY-ND-4.0", "no-derivatives"),
    ("The BSD 2-Clause License. Redistribution and use in source and binary forms", "BSD-2-Clause", "permissive"), ("Redistribution and use in source and binary forms ... Neither the name", "BSD-3-Clause", "permissive"),
    ("Redistribution and use in source and binary forms. All advertising materials mentioning features or use of this software", "BSD-4-Clause", "permissive"),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Texinfo-exception", "GPL-2.0-or-later WITH Texinfo-exception", "weak-copyleft"), ("SPDX-License-Identifier: DocumentRef-x:LicenseRef-y OR CC-BY-NC-SA-3.0", "DocumentRef-x:LicenseRef-y OR CC-BY-NC-SA-3.0", None),
])
def test_identifiers_of_the_list(text, expression, obligation):
    assert scan(text, automaton())[:2] == ("found", expression) and scan(text, automaton())[3] == obligation


def brute_phrases(text):
    """Identifiers of the notices, phrase by phrase with str.find."""
    flat = " ".join(L._LEADER.sub("\n", text.lower()).split())
    hits = []
    for phrase, ident in L.PHRASES.items():
        at = flat.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if not (at and flat[at - 1].isalnum()) and not (end < len(flat) and flat[end].isalnum()):
                hits.append((at, end, ident))
            at = flat.find(phrase, at + 1)
    longest = [x for x in hits if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in hits)]
    return sorted({i for _, _, i in longest})


def test_notices_match_a_scan_phrase_by_phrase():
    rnd = random.Random(2)
    own = [p for p, i in L.PHRASES.items() if not i.startswith("BSD")]
    for _ in range(300):
        parts = [rnd.choice([rnd.choice(own).replace(" ", rnd.choice([" ", "  ", "\n", "\n * ", "\n# "])), rnd.choice(own).upper(), "summit licensee", "x" + rnd.choice(own), rnd.choice(own) + "s", "plain words,"]) for _ in range(rnd.randint(0, 5))]
        text = rnd.choice([" ; ", "\n\n", " and "]).join(parts)
        assert scan(text, automaton())[2] == brute_phrases(text), text
