"""The small labelled table that the model of ``pii`` learns from: sentences whose personal data is marked.

Sentences are templates between words of no meaning; what fills them is drawn by rule from a seed, so
that the model learns shapes and cues, not names. A table of one's own has the same columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

# Sentences around personal data, by the cues that go with it, in four languages.
TEMPLATES = (
    "My name is {name}.",
    "my name is {name} and I",
    "Name: {name}",
    "Dear {name},",
    "Mr. {name} said",
    "Mrs. {name} wrote",
    "Dr. {name} will",
    "Contact: {name}, {phone}",
    "Contact {name} at {email}",
    "Me llamo {name}.",
    "Nombre: {name}",
    "Señora {name} vive en {address}.",
    "Je m'appelle {name}.",
    "Nom: {name}",
    "Madame {name} habite {address}.",
    "Ich heiße {name}.",
    "Herr {name} wohnt in {address}.",
    "call me at {phone}",
    "Call {phone} now",
    "Phone: {phone}",
    "Tel. {phone}",
    "Tel: {phone}",
    "Fax: {phone}",
    "Mobile {phone}",
    "my number is {phone}.",
    "Llame al {phone}",
    "Teléfono: {phone}",
    "Appelez le {phone}",
    "Téléphone: {phone}",
    "Telefon: {phone}",
    "Rufen Sie {phone} an",
    "{phone}",
    "{phone} {card}",
    "{phone} {number}",
    "{card} {phone}",
    "{card}",
    "card number {card}",
    "Visa {card} expires {date}",
    "tarjeta {card}",
    "carte {card}",
    "Karte {card}",
    "{card} {card}",
    "write to {email}",
    "Email: {email}",
    "reach me at {email}",
    "mail {email} or {phone}",
    "Correo: {email}",
    "Courriel: {email}",
    "E-Mail: {email}",
    "{email}",
    "From: {name} <{email}>",
    "IP address {ip}",
    "from {ip} port {number}",
    "{ip}",
    "| {ip} | {word} |",
    "lives at {address}.",
    "Address: {address}",
    "ship to {address}",
    "Dirección: {address}",
    "Adresse: {address}",
    "version {version} of",
    "on {date} and",
    "at {time} the",
    "costs ${price} or",
    "page {number} of {number}",
    "{number} {word} {number}",
    "| {word} | {number} | {price} |",
    'token = "{hex}"',
    "key: {hex}",
    "{word} at {word} dot {word}.",
    "{word} at {word}, {word}",
    "In {Word}, {word} {word}",
    "{Word} {word} the {Word} {word}",
    "{WORD} {WORD} {WORD} {number}!!",
    "{number}-{number}",
    "({number}) {word}",
    "https://{word}.{word}/{word}/{number}",
    "{date} {time} {word}",
    "{Word}, {number} {word}",
    "{word}$$$ {word}### {word}%%%",
    "Copyright {number} {Word} {word}.",
    "{Word}. {Word} {word}",
    "{word}. {Word}, {word}",
    "{word}. {Word}.",
    "{WORD}!! {WORD}!! AT!! {WORD}!! {WORD}.!! {WORD}!!",
    "{WORD}!! THE!! {WORD}!! OF!! {WORD}!!",
    "{Word} {word} at {word} dot. {Word}",
    "{word} {word}. {Word} {Word}, {word} {word}",
    "under the {Word} License, Version {version}.",
)
# Parts of made-up words, ends of streets, ends of hosts, and words that background is mixed with.
SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti un va ze an el is ot th er en on st ch qu br ll ée ñe ü ß".split()
STREETS = "Street Road Avenue Lane Square Drive".split()
HOSTS = "com org net example.com example.org".split()
COMMON = "the of and to in a is that for with at on by from as or de la que el en y les des et le der die und das in zu mit".split()

KINDS = ("email", "ip", "card", "phone", "name", "address")


class _Maker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, options: tuple | list) -> str:
        return options[self.rng.integers(len(options))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        return self.pick(COMMON) if self.rng.random() < 0.3 else "".join(self.pick(SYLLABLES) for _ in range(self.rng.integers(1, 5)))

    def Word(self) -> str:  # noqa: N802
        return "".join(self.pick(SYLLABLES) for _ in range(self.rng.integers(2, 4))).capitalize()

    def WORD(self) -> str:  # noqa: N802
        return self.Word().upper()

    def number(self) -> str:
        return self.digits(self.rng.integers(1, 9))

    def price(self) -> str:
        return f"{self.rng.integers(1, 2000)}.{self.digits(2)}"

    def version(self) -> str:
        return ".".join(str(v) for v in self.rng.integers(0, 30, self.rng.integers(2, 4)))

    def date(self) -> str:
        y, m, d = self.rng.integers(1950, 2040), self.rng.integers(1, 13), self.rng.integers(1, 29)
        return self.pick((f"{y}-{m:02}-{d:02}", f"{d}/{m}/{y}", f"{d:02}.{m:02}.{y}", f"{m:02}/{y % 100:02}"))

    def time(self) -> str:
        return f"{self.rng.integers(0, 24)}:{self.rng.integers(0, 60):02}"

    def hex(self) -> str:
        return "".join("0123456789abcdef"[v] for v in self.rng.integers(0, 16, 40))

    def plain(self) -> str:
        return "".join(self.pick(SYLLABLES[:-4]) for _ in range(self.rng.integers(1, 4)))

    def name(self) -> str:
        return self.pick((f"{self.Word()} {self.Word()}", f"{self.Word()} {self.Word()}", f"{self.Word()} {self.Word()[0]}. {self.Word()}", f"{self.Word()} {self.Word()} {self.Word()}"))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.pick((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{self.digits(2)} {self.digits(2)} {c} {self.digits(4)}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}"))

    def card(self) -> str:
        g = [self.digits(4) for _ in range(4)]
        return self.pick(("".join(g), "".join(g), " ".join(g), "-".join(g)))

    def ip(self) -> str:
        return ".".join(str(v) for v in self.rng.integers(0, 256, 4))

    def email(self) -> str:
        user, host = self.pick((self.plain(), f"{self.plain()}.{self.digits(2)}", f"{self.plain()}_{self.plain()}")), self.plain() + self.pick(("", self.digits(1)))
        end = self.pick(HOSTS)
        dotted = end.replace(".", " dot ")
        return self.pick((f"{user}@{host}.{end}", f"{user} at {host} dot {dotted}", f"{user} (at) {host} (dot) {end}", f"{user}[at]{host}.{end}", f"{user} AT {host} DOT {dotted}", f"{user} [at] {host} [dot] {end}"))

    def address(self) -> str:
        return f"{self.rng.integers(1, 999)} {self.Word()} {self.pick(STREETS)}"

    def sentence(self) -> str:
        words = [self.word() + ("," if self.rng.random() < 0.1 else "") for _ in range(self.rng.integers(1, 10))]
        words = [w.capitalize() if self.rng.random() < 0.1 else w for w in words]
        return " ".join([words[0].capitalize(), *words[1:]]).rstrip(",") + self.pick((".", ".", ".", "!", "?"))

    def background(self) -> str:
        """Nothing, or up to three sentences of words of no meaning, of which the last may be cut."""
        out = "".join(self.sentence() + self.pick((" ", " ", "\n")) for _ in range(self.rng.integers(0, 4))).strip()
        return out.rsplit(" ", 1)[0] if self.rng.random() < 0.4 else out


def labelled_table(rows: int = 1000, seed: int = 11) -> pd.DataFrame:
    """(text, spans) with ``spans`` a list of (kind, start, end) in code points, end exclusive."""
    make, out = _Maker(seed), []
    for i in range(rows):
        text, spans = make.background(), []
        text += " " if text else ""
        rest = TEMPLATES[i % len(TEMPLATES)]
        while "{" in rest:
            before, _, tail = rest.partition("{")
            kind, _, rest = tail.partition("}")
            value = getattr(make, kind)()
            text += before
            if kind in KINDS:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
        text += rest
        after = make.background()
        out.append((text + (make.pick((" ", " ", "\n")) + after if after else ""), spans))
    return pd.DataFrame(out, columns=["text", "spans"])
