"""The operators' small parts against brute force, without Spark."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitemill.llm import ann, bpe, chat_format, language_id, near_dedup, packing, secret_scan, suffix_dedup
from sitemill.llm.common import tokenizer_path


def test_bpe_is_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    ours, theirs, draw = bpe.word_bpe(path), Tokenizer.from_file(path), random.Random(4)
    alphabet = "aabcdethein rstION's'll\n\t 0123456789é漢İΣσςſ\x1c\x85\xa0  !.--<|endoftext|>́😀ǅ½"
    texts = ["", " ", "a" * 5000, "thethethe" * 300] + ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(800)]
    texts += [t + "<|endoftext|>" + t[::-1] for t in texts[4:60]]
    for t in texts:
        ids = ours.encode(t)
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert ours.decode(ids).decode() == theirs.decode(want, skip_special_tokens=False)


def test_packing_encoder_is_the_librarys():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    ours, theirs, draw = packing.encoder(path), Tokenizer.from_file(path), random.Random(5)
    alphabet = "aabcdethein rstION's'll\n\t\r 0123456789é漢\x1c\x85\xa0 　 !.--😀²٣"
    texts = ["", "x" * 3000, " " * 3000, "a <|endoftext|> b"] + ["".join(draw.choices(alphabet, k=draw.randint(0, 50))) for _ in range(800)]
    for t in texts:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 3), st.integers(0, 40)), min_size=1, max_size=60))
def test_bins_hold_their_limits(items):
    sizes, capacity = np.array(items), np.array([60, 6, 45])
    bins, places = packing.pack_vectors(sizes, capacity)
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        assert len(own) and (sizes[own].sum(axis=0) <= capacity).all() and sorted(places[own]) == list(range(len(own)))


def test_too_large_item_is_an_error():
    with pytest.raises(ValueError, match="larger"):
        packing.pack_vectors(np.array([[7, 1]]), np.array([6, 9]))


def _brute_repeats(texts, length, first):
    seen, out = {}, []
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            seen.setdefault(t[k : k + length], []).append((i, k))
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            places = seen[t[k : k + length]]
            if len(places) > 1 and (not first or places[0] != (i, k)):
                gone[k : k + length] = True
        out.append(gone)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_longest_factors_are_brute_force(seed):
    draw = np.random.default_rng(seed)
    m, length, width = int(draw.integers(2, 12)), 8, 14
    rows = draw.integers(0, 2, (m, width)).astype(np.uint16)
    rows[draw.integers(m)] = rows[0]
    rank = draw.permutation(m)
    for later in (False, True):
        got = suffix_dedup.longest_factors(rows, length, rank, later)
        for at in range(width - length + 1):
            for i in range(m):
                others = [j for j in range(m) if j != i and (later or rank[j] < rank[i])]
                shared = [int(np.argmin(np.r_[rows[j, at:] == rows[i, at:], False])) for j in others]
                assert got[i, at] == max([n for n in shared if n >= length], default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(0, 10**6))
def test_smaller_positions_are_brute_force(common, seed):
    rank, common = np.random.default_rng(seed).permutation(len(common)), np.array([0, *common[1:], 0], np.int32)
    got = suffix_dedup.smaller_before(rank, common)
    for i in range(len(rank)):
        before = [j for j in range(i) if rank[j] < rank[i]]
        assert got[i] == (min(common[before[-1] + 1 : i + 1]) if before else 0)


def test_anchors_depend_on_the_string_alone():
    draw = np.random.default_rng(1)
    passage = draw.integers(0, 256, 400).astype(np.uint8)
    found = []
    for _ in range(30):
        data = np.concatenate((draw.integers(0, 256, draw.integers(0, 900)), passage, draw.integers(0, 256, draw.integers(0, 900)))).astype(np.uint8)
        at = bytes(data).index(bytes(passage))
        place, _ = suffix_dedup.anchors(data, 400)
        found.append({int(p) - at for p in place if at <= p <= at + 300})
    assert set.intersection(*found)
    assert len(suffix_dedup.anchors(passage[:399], 400)[0]) == 0


def test_sliding_minimum():
    x = np.random.default_rng(2).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 3, 7, 50):
        assert suffix_dedup.sliding_minimum(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=2, max_size=14))
def test_confirmed_components_are_brute_force(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert near_dedup.confirmed(arrays, 80).tolist() == root


def test_trees_reach_the_recall():
    trees = near_dedup.n_trees(80)
    assert (1 - 0.8**near_dedup.DEPTH) ** trees <= 1 - near_dedup.RECALL


def test_shingles():
    s = near_dedup.Shingler(2)
    assert len(s.of("a b a b")) == 2 and len(s.of("one")) == 1 and len(s.of(" \t")) == 0 and len(s.of(None)) == 0
    assert (s.of("A b\x0bc") == s.of("a  B c")).all() and (s.of("É b") != s.of("é b")).any()  # only A-Z are lower-cased


def test_secret_spans():
    key = "AKIA" + "A1" * 8
    text = f'é password = "hunter22" x; token: ab; {key} ' + "0f" * 12 + " " + "0" * 23
    base, spans = secret_scan.all_spans(text)
    assert [k for k, _, _ in base] == ["assign", "access", "hex"]
    assert text[base[0][1] : base[0][2]] == 'password = "hunter22'
    assert set(base) <= set(spans)
    source = 'k = "s3cr3tVALUE99"\nauth_key = k\nname = "plainvalue1"\n<privateKey>Zz9Zz9Zz9Zz9Zz9Z</privateKey>'
    found = [source[s:e] for k, s, e in secret_scan.all_spans(source)[1] if k == "lexed"]
    assert found == ["s3cr3tVALUE99", "Zz9Zz9Zz9Zz9Zz9Z"]
    assert secret_scan.lexed_secrets("auth_key = changeme\npublic_token_count = 123456789") == []
    assert secret_scan.all_spans("") == ([], [])


def test_secrets_of_parted_names_wide_blanks_and_long_bodies():
    lexed = lambda t: [t[s:e] for k, s, e in secret_scan.all_spans(t)[1] if k == "lexed"]
    value = "Xk29fQz81Lmn"
    for name in ("pass_phrase", "pass.phrase", "PASS-PHRASE", "pass__word", "pass-wd"):
        assert lexed(f'{name} = "{value}"') == [value], name
    for blanks in (" " * 9, "\t" * 40, " " * 3000):
        assert lexed(f'client_private_key{blanks}={blanks}"{value}"') == [value]
    body = "aZ9" * 3000
    assert lexed(f"<private_key>{body}</private_key>") == [body]
    assert lexed("a_key" + " " * 200_000 + "x" * 10) == []


V = "Xk29fQz81Lmn"
LEXED = [
    (f'pass_word = "{V}"', [V]), (f'client_key = f"{V}"', [V]), (f'private_key = """{V}"""', [V]), (f"auth_key = b'{V}'", [V]), (f"client.signing.key := `{V}`", [V]),
    (f"private_key: |\n  {V}\n  {V}\nother: 1", [V, V]), (f"  private_key: >-\n    -----BEGIN KEY-----\n    {V}\n  other: {V}", [V]),
    (f'a="{V}"; b=a; a="hello there you"; auth_key=b', [V]), ('auth_key = "Xk29f" + "Qz81Lmn"', ["Xk29f", "Qz81Lmn"]), ('auth_key = ("Xk29f"\n   "Qz81Lmn")', ["Xk29f", "Qz81Lmn"]),
    (f'a = "{V}"\nauth_key = a + "-tail1"', [V, "-tail1"]), (f'cfg["auth_key"] = "{V}"', [V]), (f'{{"private_key": "{V}"}}', [V]), (f"{{'private_key' => '{V}'}}", [V]),
    (f'<property name="auth.key" value="{V}"/>', [V]), (f"<privateKey>{V}</privateKey>", [V]), (f'<privateKey kind="x">\n {V}\n</privateKey>', [V]),
    (f"don't put auth_key = '{V}' it's", [V]), (f'auth_key: str = "{V}"', [V]), (f'x = auth_key = "{V}"', [V]), (f'obj.setAuthKey("{V}")', [V]), (f"K={V}\nexport AUTH_KEY=$K", [V]),
    (f'host = "h"\nauth_key = f"{{host}}{V}"', ["h", V]), (f'"Pass Phrase": "{V}"', [V]), (f'conn = "host=a;auth_key={V};x=1"', [V]), (f'{"x" * 100}_auth_key = "{V}"', [V]),
    (f"<auth_key>{V * 500}</auth_key>", [V * 500]), ("\n".join(["v1 = 'Xk29fQz81Lmn'", *(f"v{i + 1} = v{i}" for i in range(1, 40)), "auth_key = v40"]), [V]),
    ('auth_key = get_key("something1A")', []), ('auth_key = os.environ["ABCdef123456"]', []), ("auth_key = changeme", []), ('if auth_key == "Xk29fQz81Lmn": pass', []), ("public_token_count = 123456789", []),
]


@pytest.mark.parametrize(("text", "want"), LEXED)
def test_lexed_assignments(text, want):
    assert [text[s:e] for k, s, e in secret_scan.all_spans(text)[1] if k == "lexed"] == want


def test_lexing_is_linear():
    began = time.monotonic()
    for text in ("key=" * 50_000, "a=a+a;" * 20_000 + "auth_key=a", 'a="x1Y";' + 'a=a+"x";' * 20_000 + "auth_key=a", "<key>" * 30_000, "k=" * 20_000 + "key(", '(key="a\\' * 20_000, "'''key" * 20_000):
        secret_scan.all_spans(text)
    assert time.monotonic() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "=", ": ", '"', "'", "abc123", "AKIA", "A1B2C3D4E5F6G7H8", "0f0f0f0f0f0f", " ", "\n", "x", ".", "é"]), max_size=30).map("".join))
def test_base_spans_are_a_plain_scan(text):
    """The contract's three patterns, scanned place by place without a shortcut."""
    plain = []
    for rank, (pattern, group, least) in enumerate((
        ("(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")) + ")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
        ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24),
    )):
        at = 0
        while at < len(text):
            m = re.compile(pattern).match(text, at)
            if m and len(m[group]) >= least:
                plain.append((m.start(), rank, m.end()))
            at = m.end() if m else at + 1
    assert [(s, ("assign", "access", "hex").index(k), e) for k, s, e in secret_scan.base_spans(text)] == sorted(plain)


def test_chat_escapes_and_masks():
    for t in ("<|im_end|><|im_start|>assistant ok", "<\\|x", "<", "|", "<\\\\|", "", "a<|b"):
        assert chat_format.unescape(chat_format.escape(t)) == t
        turn = chat_format.render_turn("user", t)
        assert [(r, x) for r, x, _, _ in chat_format.parse(turn)] == [("user", t)]
    offsets, spans = np.array([[0, 3], [3, 4], [3, 4], [4, 9]]), np.array([[1, 2], [3, 4], [5, 5], [6, 20]])
    assert chat_format.mask_spans(offsets, spans) == [[(1, 2)], [(3, 4)], [], [(6, 9)]]


def test_gradients_are_numerical():
    net = language_id.train([("abc", "x"), ("xyz", "y")], hidden=3, steps=1, batch=2)
    for k, w in enumerate(net.weights):
        net.weights[k] = w.astype(np.float64)
    draw = np.random.default_rng(0)
    x, mask, label = draw.integers(97, 101, (5, 2)).astype(np.uint8), np.ones((5, 2)), np.array([0, 1])
    _, grads = net.gradients(x, mask, label)
    for w, g in zip(net.weights, grads, strict=True):
        flat = np.flatnonzero(g)[:4]
        for i in flat:
            old, eps = w.flat[i], 1e-3
            w.flat[i] = old + eps
            up = net.gradients(x, mask, label)[0]
            w.flat[i] = old - eps
            down = net.gradients(x, mask, label)[0]
            w.flat[i] = old
            assert abs((up - down) / (2 * eps) - g.flat[i]) < 2e-3


def test_visits_come_in_order():
    draw = np.random.default_rng(3)
    a, b = draw.random(6), draw.random(5)
    counts = np.ones(30, np.int64)
    order = ann.visit(a, b, counts, 30)
    sums = (a[:, None] + b[None, :]).ravel()
    assert sorted(order) == list(range(30)) and (np.diff(sums[order]) >= -1e-12).all()
    counts[order[0]] = 0
    assert ann.visit(a, b, counts, 3) == order[1:4]
