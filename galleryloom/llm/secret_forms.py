"""Labelled findings for the secret scan: a generator per form of secret and of harmless token, set into contexts.

Corpora hold few labelled secrets, and of few forms. Each form here draws values from its own alphabet and shape; issued keys may
stand anywhere, other secrets are assigned to a credential name, and harmless tokens stand in text or behind plain names.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable

LETTERS, DIGITS, ALNUM = string.ascii_letters, string.digits, string.ascii_letters + string.digits
HEX, UPPER = "0123456789abcdef", string.ascii_uppercase + string.digits
PER_FORM = 150
# Names that credentials are assigned to, and names that are not.
CREDENTIAL_NAMES = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "client_secret", "SECRET_KEY", "access_token", "auth", "aws_secret_access_key",
    "DB_PASSWORD", "auth_token", "private_key", "credentials",
)
PLAIN_NAMES = ("id", "name", "page", "sort", "order", "title", "lang", "ref", "version", "date", "item", "size", "color", "session", "user", "commit", "checksum", "build")


def _some(draw: random.Random, alphabet: str, low: int, high: int | None = None) -> str:
    """Random characters, letters and digits both among them where the alphabet has both."""
    while True:
        text = "".join(draw.choices(alphabet, k=draw.randint(low, high or low)))
        if not (set(alphabet) & set(DIGITS) and set(alphabet) & set(LETTERS)) or (set(text) & set(DIGITS) and set(text) & set(LETTERS)):
            return text


def _passphrase(draw: random.Random, word: Callable[[], str]) -> str:
    """Words with digits and signs in or behind them, of twelve characters or more."""
    kind = draw.randrange(4)
    a, b = word(), word()
    if kind == 0:
        text = f"{a}{draw.randint(1, 99)}{a}{draw.randint(1, 99)}"
    elif kind == 1:
        text = f"{a.capitalize()}{draw.choice('0345')}{b}{draw.choice('&!#$%')}{draw.randint(1, 9)}{_some(draw, string.ascii_lowercase, 2, 4)}"
    elif kind == 2:
        text = f"{a.capitalize()}{b.capitalize()}{draw.randint(1950, 2030)}"
    else:
        text = f"{a}-{draw.randint(0, 99)}-{b}-{_some(draw, string.ascii_lowercase, 3, 6)}"
    return text if len(text) >= 12 else text + _some(draw, ALNUM, max(2, 12 - len(text)))


def issued(draw: random.Random) -> list[str]:
    """One value of every form that is known by its own shape."""
    return [
        draw.choice(("AKIA", "ASIA")) + _some(draw, UPPER, 16), f"gh{draw.choice('pousr')}_" + _some(draw, ALNUM, 36),
        f"xox{draw.choice('abp')}-{_some(draw, DIGITS, 11, 12)}-{_some(draw, ALNUM, 10, 24)}", "AIza" + _some(draw, ALNUM + "_-", 35), "sk_live_" + _some(draw, ALNUM, 16, 28),
        f"eyJ{_some(draw, ALNUM, 17, 33)}.eyJ{_some(draw, ALNUM + '_-', 20, 60)}.{_some(draw, ALNUM + '_-', 43)}",
    ]


def assigned(draw: random.Random, word: Callable[[], str]) -> list[str]:
    """One value of every form that is a secret behind a credential name."""
    return [
        _some(draw, HEX, draw.choice((18, 32, 40, 64))), _some(draw, ALNUM + "/+", 40), _some(draw, ALNUM, 14, 36), _some(draw, ALNUM + "_-", 20, 44),
        _passphrase(draw, word), _passphrase(draw, word),
    ]


def harmless(draw: random.Random, word: Callable[[], str]) -> list[str]:
    """One value of every form that is no secret."""
    n = lambda low, high: str(draw.randint(low, high))
    date = f"{n(1900, 2030)}-{n(1, 12).zfill(2)}-{n(1, 28).zfill(2)}"
    return [
        f"{word()}.{word()}{n(1, 99)}@{word()}.{draw.choice(('org', 'com', 'net'))}", f"https://{word()}.example.{draw.choice(('org', 'com'))}/{word()}/{word()}{n(1, 9999)}",
        f"{word()}/{word()}/{word()}{n(1, 99)}.{draw.choice(('txt', 'csv', 'py', 'html'))}", f"{word()}_{word()}_{n(1, 999)}.{draw.choice(('jpg', 'png', 'pdf'))}",
        f"v{n(0, 20)}.{n(0, 30)}.{n(0, 99)}-{draw.choice(('beta', 'rc', 'alpha'))}{n(1, 9)}", f"{date}T{n(10, 23)}:{n(10, 59)}:{n(10, 59)}", date,
        f"+{n(1, 99)}-{n(100, 999)}-{n(1000, 9999)}-{n(100, 999)}", f"{n(1, 999)},{n(100, 999)},{n(100, 999)}.{n(10, 99)}", n(10_000_000, 10**12),
        f"{word()}{word()}{n(1, 999)}", f"{_some(draw, HEX, 8)}-{_some(draw, HEX, 4)}-{_some(draw, HEX, 4)}-{_some(draw, HEX, 4)}-{_some(draw, HEX, 12)}",
        f"{n(1, 255)}.{n(100, 255)}.{n(1, 255)}.{n(1, 255)}:{n(80, 9999)}", f"{word()}-{word()}-{n(1, 99)}", f"#{word()}{n(1000, 9999)}",
    ]


# How a value is assigned to a name, and how a token stands in text.
ASSIGNMENTS = ('{n}={v}', '{n}: {v}', '{n} = "{v}"', "'{n}': '{v}'", '{{"{n}":"{v}"}}', '{n}="{v}"', '{n} = {v}', '{n}:{v}')
STANDING = ("{v}", "({v})", '"{v}"', "{v},", "{v}.")


def examples(words: list[str], per_form: int = PER_FORM, seed: int = 7) -> list[tuple[str, str, float]]:
    """(text, value, label): `per_form` texts of each form, between words of the corpus."""
    draw = random.Random(seed)
    words = words or ["word", "text", "line"]
    word = lambda: draw.choice(words)
    out = []

    def put(carrier: str, name: str, value: str, label: float) -> None:
        around = [" ".join(draw.choices(words, k=draw.randint(0, 4))) for _ in range(2)]
        out.append((f"{around[0]} {carrier.format(n=name, v=value)} {around[1]}".strip(), value, label))

    for _ in range(per_form):
        for value in issued(draw):
            standing = draw.random() < 0.5
            put(draw.choice(STANDING if standing else ASSIGNMENTS), draw.choice(CREDENTIAL_NAMES + PLAIN_NAMES), value, 1.0)
        for value in assigned(draw, word):
            put(draw.choice(ASSIGNMENTS), draw.choice(CREDENTIAL_NAMES), value, 1.0)
        put("Authorization: Bearer {v}", "", _some(draw, ALNUM + "_-", 24, 60), 1.0)
        address = f"{word()}:{_some(draw, ALNUM, 8, 20)}@{word()}.example.org"
        put(draw.choice(("postgres://{v}/db", "https://{v}/x", "ftp://{v}")), "", address, 1.0)
        for value in harmless(draw, word):
            standing = draw.random() < 0.6
            put(draw.choice(STANDING if standing else ASSIGNMENTS), draw.choice(PLAIN_NAMES), value, 0.0)
        digest = _some(draw, HEX, draw.choice((32, 40, 64)))
        put(draw.choice(("commit {v}", "sha256: {v}", "checksum={v}", "md5 {v}", "build {v}", "({v})")), "", digest, 0.0)
    return out
