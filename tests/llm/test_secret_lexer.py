"""The lexer's scopes and the forms in which source and configuration give a name its value; what is no secret; time on long texts."""

from __future__ import annotations

import time

import pytest

from sitemill.llm import secret_scan

K = "qX7v9Lm2Zt4Rb8Nw"
FORMS = [
    (f'def f(): k = "{K}"\ndef g(): password = k\n',[]),
    (f'def f():\n    k = "{K}"\n    password = k\n',[K]),
    (f'k = "{K}"\ndef f():\n    password = k\n',[K]),
    (f'function f() {{\n  k = "{K}";\n}}\nfunction g() {{\n  password = k;\n}}\n',[]),
    (f'function f() {{\n  k = "{K}";\n  password = k;\n}}\n',[K]),
    (f'user, password = "joe", "{K}"',[K]),
    (f'password = "{K[:8]}"\npassword += "{K[8:]}"',[K[:8],K[8:]]),
    (f'password = "%s" % "{K}"',[K]),
    (f'password = "".join(["{K[:8]}", "{K[8:]}"])',[K[:8],K[8:]]),
    (f'password = os.getenv("PW", "{K}")',[K]),
    (f'password = os.environ.get("X") or "{K}"',[K]),
    (f'password:\n  value: {K}\n',[K]),
    ('"auth_token": {"value": "%s"}'%K,[K]),
    (f'#define PASSWORD "{K}"',[K]),
    (f"define('DB_PASSWORD', '{K}')",[K]),
    (f'mysql --password {K} -h x',[K]),
    (f'Authorization: Bearer {K}',[K]),
    (f'postgres://joe:{K}@host/db',[K]),
    (f"CREATE USER x IDENTIFIED BY '{K}'",[K]),
    (f'<input type="password" value="{K}">',[K]),
    (f'PASSWORD=$(cat <<EOF\n{K}\nEOF\n)',[K]),
    ('password_policy = "AtLeast8Chars1"',[]),
    (f'password = x or "{K}"',[K]),
    ('password:\n  min: 8\nother:\n  value: %s\n'%K,[]),
    ('{"password": {"x": 1}, "other": {"value": "%s"}}'%K,[]),
    (f'a, b = "{K}", "x"',[]),
    (f'x = a if b else "{K}"',[]),
    ('see http://example.com:8080/a@b and mail joe@example.com',[]),
    (f'password = lookup("{K}")',[]),
]
LONG = ("password: \n"*20000,'"auth": {'*20000,"value: x1\n"*20000+"password:\n","password:\n"+"  value: zz9\n"*20000,"<input "*20000,"a, "*50000+"b = 1","def f(): x = 1\n"*20000,"PASSWORD=<<EOF\n"*10000,"--password "*20000,"://"*50000+"@password","password = \"a\" % "*20000)


@pytest.mark.parametrize(("text", "want"), FORMS)
def test_forms(text, want):
    assert sorted(text[s:e] for s, e in secret_scan.lexed_secrets(text)) == sorted(want)


@pytest.mark.parametrize("text", LONG)
def test_time_grows_with_the_text(text):
    began = time.process_time()
    secret_scan.lexed_secrets(text)
    half = time.process_time() - began
    began = time.process_time()
    secret_scan.lexed_secrets(text * 2)
    assert time.process_time() - began < 4 * half + 1.0
