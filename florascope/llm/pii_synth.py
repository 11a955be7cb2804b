"""Labelled training text made up around real sentences: items by format generators, put where any sentence can hold one.

The sample of a corpus shows each kind in few surroundings. Here names, numbers and addresses of many makes are set into the corpus's
own sentences at arbitrary places, beside look-alikes that are no personal items, so that the tagger learns the items and the
general words around them instead of a corpus's phrases.
"""

from __future__ import annotations

import numpy as np

# Common names of several regions, fixed values; names of the corpus's list and made-up ones are mixed in.
GIVEN = (
    "Anna Maria John Peter Sonam Pema Dorji Ugyen Kinley Chimi Namgay Rinzin Ahmed Fatima Mohammed Aisha Wei Li Ming Yuki Hiroshi Kenji Priya Rahul "
    "Anjali Arjun Carlos Lucia Jose Carmen Pedro Elena Ivan Olga Dmitri Natalia Hans Greta Klaus Ingrid Pierre Claire Jean Sophie Marco Giulia Luca "
    "Francesca James Mary Robert Linda David Susan Thomas Karen Daniel Emily Kwame Ama Chidi Ngozi Tenzin Lobsang Bikram Sita Ram Gita Lars Astrid Björn"
).split()
FAMILY = (
    "Brown Jones Taylor Wilson Clark Walker Wright Hall Green Baker Adams Nelson Carter Mitchell Roberts Müller Schmidt Schneider Fischer Weber Meyer "
    "Wagner Becker Dubois Martin Bernard Durand Moreau Garcia Martinez Rodriguez Fernandez Sanchez Perez Gomez Rossi Russo Ferrari Bianchi Ivanov Petrov "
    "Wang Zhang Chen Liu Yang Tanaka Suzuki Sato Kumar Sharma Singh Patel Gupta Thapa Gurung Rai Tamang Tshering Wangchuk Namgyel Penjor Okafor Mensah "
    "Diallo Hassan Khan Ali Nielsen Hansen Larsen Olsen O'Brien Murphy Novak Kowalski"
).split()
_SYLLABLES = "ba be bor da del den dor fa fen ga gar gel ha hol in ka kel kin la lem lo ma mar mer mi na nor o pa pel quin ra ren ri ro sa sel sha ta tar tel tir u va vel ver wan wil ya yor za zan".split()
_BEFORE_NAME = "by with for from to and of ask asked see told met per thanks via von mit für an bei durch und par avec pour de à et por con para y a said wrote when where because if that".split()
_AFTER_NAME = "took wrote sent checked measured found held said called left came was is has had will and with from who at in on agreed reports noted counted carried repaired et y und a hat war fue prit".split()
_ROLES = "Author Reviewer Observer Contact Team Driver Guide Checked Written Entered Signed Lead Owner Tel Kontakt Autor Auteur Name Nombre Nom Leg Leiter Chef Jefe".split()
_TITLES = "Dr. Prof. Mr Mr. Mrs Mrs. Ms Ms. Miss Mme M. Mlle Herr Herrn Frau Sr. Sra. Señor Det. Dame Sir".split()
_PHONE_CUES = "phone telephone tel tel. Tel. mobile cell call ring Ring fax tél. téléphone teléfono móvil Telefon Handy mobil portable phone: tel: Tel.: mobile:".split()
_ID_CUES = "citizen ID|citizen ID no.|CID|CID=|ID card|identity card no.|identity card|national ID|passport|passport no.|Passport|staff card|staff card:|Ausweis-Nr.|Ausweis|Personalausweis|Reisepass|Carte d'identité no|CNI|passeport|Documento de identidad|DNI|Pasaporte|id=|identity number".split("|")
_STREETS = "Oak Mill Church Station High Garden River Hill Temple Market Bridge Park Lake School Forest Castle Rose Cedar Willow Spring King Queen Victoria Norzin Chang Babesa".split()
_TOWN_WORDS = "Upper Lower Old New North South East West Great Little Saint".split()
_KINDS = "Street St St. Road Rd Rd. Lane Way Lam Market Avenue Ave Square Row Close Drive Court Terrace".split()
_PLAIN_NUMBERS = "barcode|herbarium barcode|sample no.|specimen|batch|Batch|permit no.|Permit|order|invoice|record|Record|grid cell|plot|Plot|hash|row|tag|marker|accession|sheet|ISBN|doi|serial|photo|voucher|version|on|at|from|read|gps|coordinates|elevation|Muestra|Probe|Beleg|échantillon".split("|")
_PLACES = "Mount Lake Lower Upper North South East West Old New Camp Fort Cape Port Glen Valley Saint Ridge".split()
_THINGS = "Ridge Pass Valley Moor Tarn Cleft Forest Park River Station School Office University Department Survey Herbarium Project Dell Bank Terrace Group Peak Creek".split()


class Maker:
    """Draws items and their look-alikes; given and family: the corpus's own list."""

    def __init__(self, rng: np.random.Generator, given: list[str], family: list[str]) -> None:
        self.rng, self.given, self.family = rng, given, family

    def of(self, xs: list[str]) -> str:
        return xs[int(self.rng.integers(len(xs)))]

    def num(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        return "".join(self.of(_SYLLABLES) for _ in range(int(self.rng.integers(2, 4)))).capitalize()

    def _part(self, listed: list[str], common: list[str]) -> str:
        r = self.rng.random()
        return self.of(listed) if listed and r < 0.35 else self.of(common) if r < 0.7 else self.word()

    def name(self) -> str:
        g, f, r = self._part(self.given, GIVEN), self._part(self.family, FAMILY), self.rng.random()
        initial = g[0].upper() + "."
        n = (
            f"{g} {f}" if r < 0.5 else f"{initial} {f}" if r < 0.62 else f"{g} {self.of('ABCDEFGHKLMNPRSTW')}. {f}" if r < 0.74 else f"{f}, {g}" if r < 0.86
            else f"{f}, {initial}" if r < 0.9 else f"{g} {f}".upper()
        )
        return n

    def email(self) -> str:
        g, f, r = self._part(self.given, GIVEN).lower(), self._part(self.family, FAMILY).lower(), self.rng.random()
        left = f"{g}.{f}" if r < 0.2 else f"{g}_{f}" if r < 0.35 else f"{g[0]}{f}" if r < 0.5 else f"{f}{self.num(2)}" if r < 0.65 else f"{g}+{self.word().lower()}" if r < 0.8 else f"{self.word().lower()}-{f}"
        host = [self.word().lower() for _ in range(int(self.rng.integers(1, 4)))] + [self.of("com org net example test invalid bt de fr es edu info".split())]
        at, dot = [("@", "."), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")][int(self.rng.choice(4, p=[0.7, 0.12, 0.12, 0.06]))]
        out = left + at + dot.join(host)
        return out.upper() if self.rng.random() < 0.1 else out

    def phone(self) -> str:
        n, r = self.num, int(self.rng.integers(16))
        return [
            lambda: f"+{n(3)} {n(2)} {n(3)} {n(3)}", lambda: f"+{n(2)} {n(2)} {n(4)} {n(4)}", lambda: f"+{n(3)}-{n(1)}-{n(3)}-{n(4)}", lambda: f"00{n(3)} {n(8)}",
            lambda: f"(0{n(1)}) {n(3)}-{n(4)}", lambda: f"0{n(1)}/{n(7)}", lambda: f"0 {n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", lambda: f"{n(2)} {n(3)} {n(3)}",
            lambda: f"{n(3)}-{n(4)}", lambda: f"+{n(3)}(0){n(2)}.{n(3)}.{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}.{n(3)}.{n(4)}",
            lambda: f"0{n(2)} {n(4)} {n(4)}", lambda: f"{n(2)}\u00a0{n(3)}\u00a0{n(3)}", lambda: f"0{n(10)}", lambda: f"+{n(11)}",
        ][r]()

    def id(self) -> str:
        n, c = self.num, lambda: self.of("ABCEFGHKLMNPRSTVXYZ")
        return [
            lambda: n(11), lambda: f"{n(3)} {n(3)} {n(5)}", lambda: f"{c()}{n(7)}", lambda: f"{c()} {n(7)}", lambda: f"{n(1)}-{n(2)}-{n(2)}-{n(6)}",
            lambda: f"{c()}{c()}-{n(6)}-{c()}", lambda: f"{c()}{n(8)}", lambda: f"{n(8)}{c()}", lambda: f"{c()}{c()}{n(7)}", lambda: n(9), lambda: f"{n(4)} {n(4)} {n(4)}",
        ][int(self.rng.integers(11))]()

    def town(self) -> str:
        return (self.of(_TOWN_WORDS) + " " if self.rng.random() < 0.25 else "") + self.word()

    def address(self) -> str:
        n = lambda a, b: int(self.rng.integers(a, b))
        street = " ".join(self.of(_STREETS) if self.rng.random() < 0.6 else self.word() for _ in range(1 + (self.rng.random() < 0.3)))
        post, r = (" " + self.num(5) if self.rng.random() < 0.6 else ""), self.rng.random()
        house = f"House No. {n(1, 200)}, " if r < 0.2 else f"Flat {n(1, 20)}{self.of('ABCD')}, " if r < 0.3 else ""
        no = f"{n(1, 200)}" + (f"/{n(1, 9)}" if self.rng.random() < 0.2 else "")
        if r < 0.2:
            out = f"{house}{street} {self.of(_KINDS)}, {self.town()}{post}"
        elif r < 0.65:
            out = f"{house}{no} {street} {self.of(_KINDS)}, {self.town()}{post}"
        elif r < 0.77:
            out = f"{n(1, 200)} {self.of(['rue', 'avenue', 'rue de', 'chemin'])} {street}, {self.num(5)} {self.town()}"
        elif r < 0.89:
            out = f"{self.of(['Calle', 'Avenida', 'Plaza', 'Via'])} {street} {n(1, 200)}, {self.num(5)} {self.town()}"
        else:
            out = f"{street.replace(' ', '')}{self.of(['weg', 'straße', 'gasse', 'platz'])} {n(1, 200)}, {self.num(5)} {self.town()}"
        return out.upper() if self.rng.random() < 0.15 else out

    def plain(self) -> str:
        """What looks like an item and isn't one."""
        n, r = self.num, self.rng.random()
        if r < 0.5:
            value = [self.id, lambda: n(11), lambda: f"{n(2)}.{n(4)}, {n(2)}.{n(4)}", lambda: f"20{n(2)}-0{n(1)}-1{n(1)}", lambda: f"{self.of('ABFN')}P/20{n(2)}/{n(5)}", lambda: n(8), lambda: f"NP{n(8)}"]
            return f"{self.of(_PLAIN_NUMBERS)} {value[int(self.rng.integers(len(value)))]()}"
        if r < 0.8:
            return f"{self.of(_PLACES)} {self.word()}" if self.rng.random() < 0.5 else f"{self.word()} {self.of(_THINGS)}"
        return f"{self.word()} {self.word().lower()}" if r < 0.95 else f"{self.of('Monday Tuesday Friday January March June'.split())} {self.word()} {n(2)}"

    def sentence(self, base: str) -> tuple[str, list[tuple[int, int, str]]]:
        """base with one or two items or look-alikes put in, and where the items are."""
        parts: list[tuple[str, str]] = []
        words = base.split(" ")
        cut = int(self.rng.integers(0, len(words) + 1))
        left, right = " ".join(words[:cut]), " ".join(words[cut:])
        kind = ("name", "name", "name", "name", "name", "phone", "id", "email", "address", "", "")[int(self.rng.integers(11))]
        r = self.rng.random()
        end = self.of([".", ".", ",", ";", "", " -", " for", " and", " or", ")"])
        if kind == "":
            parts = [(left + " ", ""), (self.plain(), ""), (end + " " + right, "")]
        elif kind == "name":
            title = self.of(_TITLES) + " " if self.rng.random() < 0.2 else ""
            if r < 0.3:
                lead = left + ("" if not left or left[-1] in ".:;\n" else ".") + " " if left else ""
                parts = [(lead + title, ""), (self.name(), kind), (" " + self.of(_AFTER_NAME) + " " + right, "")]
            elif r < 0.8:
                before = "" if r < 0.5 else self.of(_BEFORE_NAME) + " "
                parts = [(f"{left} {before}{title}".lstrip(), ""), (self.name(), kind), ((end if self.rng.random() < 0.5 else "") + " " + right, "")]
            else:
                parts = [(f"{left} {self.of(_ROLES)}{self.of([': ', ' ', ', ', '=', chr(10)])}{title}".lstrip(), ""), (self.name(), kind), (self.of([". ", chr(10), ", ", " (", "; "]) + right, "")]
        else:
            item = getattr(self, kind)()
            cue = self.of(_PHONE_CUES) if kind == "phone" else self.of(_ID_CUES) if kind == "id" else self.of("at lives at, address: home to hang mail from Adresse an dirección: write < mailto: Correo: mail=".split())
            who = self.name() if self.rng.random() < 0.25 else ""
            if who and kind == "id" and self.rng.random() < 0.5:
                parts = [(left + " ", ""), (who, "name"), (" (", ""), (item, kind), (") " + right, "")]
            else:
                if kind == "address" and self.rng.random() < 0.3:
                    cue = ""
                join = "" if cue[-1:] in "=<:" and self.rng.random() < 0.5 else " " if cue else ""
                parts = [(left + (" " if left else ""), "")] + ([(who, "name"), (self.of([", ", "; ", " "]), "")] if who else []) + [(cue + join, ""), (item, kind), (end + " " + right, "")]
        text, found = "", []
        for s, k in parts:
            if k:
                found.append((len(text), len(text) + len(s), k))
            text += s
        return text, found
