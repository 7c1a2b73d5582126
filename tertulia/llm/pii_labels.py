"""Labelled spans of personal data for training: rules over real turns, and invented ones set into real turns.

Only the training uses this module. Labels are (start, end, kind) of characters.
"""

from __future__ import annotations

import random
import re
from collections import Counter

KINDS = ["email", "phone", "id_number", "address", "name"]

# Given names, number words, and words that make a number something else than personal.
GIVEN = (
    "Águeda Rosa Andrés Ofelia Salvador Maite Ubaldo Ismael Yolanda Leocadio Fidelia Inés Julián Noelia Nicanor Wenceslao Jacinta Bernarda Teófila Carmen Marcelina Eusebio Anselmo Amparo Elvira "
    "Mateo Gervasio Saturnino Lucía Paz Bruno Ramona Primitivo Óscar Clotilde Íñigo Tomás Violeta Zenón Hortensia"
).split()
MORE_GIVEN = (
    "María José Juan Luis Ana Pedro Carlos Marta Jorge Elena Pablo Sofía Diego Laura Camila Rodrigo Valentina Felipe Daniela Sebastián Francisca Cristóbal Javiera Ignacio Catalina Matías Constanza Tamara "
    "Vicente Antonia Benjamín Isidora Joaquín Fernanda Gonzalo Paola Mauricio Claudia Héctor Gloria Raúl Silvia Hernán Patricia Sergio Verónica Eduardo Mónica Ricardo Teresa Ester Rebeca Aurelio Casimiro Delfina Eulalia Fermín Genoveva Higinio Jovita"
).split()
TENS = {"cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
DIGIT_WORDS = list(TENS)
SPOKEN_NUMBERS = "setenta y siete;ciento ocho;cuatrocientos doce;mil ciento uno;dos mil treinta;veintitrés;doscientos cuarenta;trescientos cinco;quince;noventa y uno;mil quinientos;ochocientos dos;cuarenta y seis;tres mil doscientos diez".split(";")
NOT_PERSONAL = "serie planilla ticket folio muestra medidor lote sala página resolución versión puntaje presupuesto código unas casi factura expediente contrato".split()

_NUM_WORD = r"(?:cero|un|uno|una|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|diecis[eé]is|diecisiete|dieciocho|diecinueve|veinte|veinti\w+|treinta|cuarenta|cincuenta|sesenta|setenta|ochenta|noventa|cien|ciento|doscientos|trescientos|cuatrocientos|quinientos|seiscientos|setecientos|ochocientos|novecientos|mil)"
_NUM_WORD += r"\b"
_SPOKEN = rf"{_NUM_WORD}(?:\s+y)?(?:\s+{_NUM_WORD}(?:\s+y)?)*"
_DIGIT = "(?:cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve)"
EMAIL = re.compile(r"(?<![\w.@-])\w+(?:[.\-_]\w+)*(?:\s(?:punto|guion bajo|guion)\s\w+(?:[.\-_]\w+)*)*(?:\s?@\s?|\s?[(\[](?:arroba|at)[)\]]\s?|\sarroba\s)\w+(?:(?:\.|-|\spunto\s|\sguion\s)\w+)*(?:\.|\spunto\s)[a-z]{2,}", re.I)
SPOKEN_DIGITS = re.compile(rf"\b{_DIGIT}(?:,?\s+{_DIGIT}){{6,}}(?:\s+guion\s+(?:{_DIGIT}|ka))?\b", re.I)
PHONE = re.compile(r"\+\d{2,3}[\s.\-]?\d{1,3}(?:[\s.\-]?\d{3,4}){2}(?!\d)|\b00\d{2}-\d-\d{8}\b|\(0?\d{1,2}\)\s?\d{3}\s?\d{4}\b|\b555\s\d{2}\s\d{2}\b|\b9-\d{4}-\d{4}\b|\b90\d{7}\b")
ID = re.compile(r"\b\d{1,2}\.\d{3}\.\d{3}-[\dk]\b|\b\d{7,8}-[\dk]\b|\b\d{8}k\b|\b\d{1,2}\s\d{3}\s\d{3}\sguion\s(?:\d|k|ka)\b|\b0-\d{4}-\d{4}\b|\b[A-Z]-\d{7}\b|\b4\d{8}\b", re.I)
_STREET = r"(?:(?:la\s)?(?:calle|avenida|avda\.?|av\.?|pasaje|pje\.?|camino|callejón)\s)?(?:(?:los|las|el|la)\s)?"
_STREET_WORDS = r"\w+(?:\s(?:del?|de\sla|de\slos|la|el)\s\w+|\s(?!(?:casa|n[úu]mero|block|me|al|y|con)\b)\w+){0,2}"
_HOUSE = rf"(?:,?\s#\d+(?:,?\sdepto\.?\s\w+)?|,?\s(?:N°|Nº|n°|núm\.)\s?\d+(?:-[a-z])?|,?\s(?:n[úu]mero)\s(?:\d+|{_SPOKEN})|,?\scasa\s\d+|\s\d{{1,4}}(?:-[a-z])?\b)"


def streets(texts: list[str]) -> list[str]:
    """Names of streets that the texts have with a number mark, most frequent first."""
    found: Counter = Counter()
    for t in texts:
        for m in re.finditer(r"(?:(?:calle|pasaje|avenida|av\.)\s|\b(?:en|a|llegó a|de la calle)\s)((?:(?:los|las|el|la|tres)\s)?[^\W\d_]+(?:\s(?:del?\s)?[^\W\d_]+){0,3}?)(?:,?\s#\d+|\s(?:n°|número)\s|,\scasa\s\d)", t, re.I):
            name = re.sub(r"^(?:calle|pasaje|avenida|av\.)\s", "", m[1], flags=re.I).lower()
            found[name] += 1
    return [n for n, k in found.most_common() if k >= 2 and len(n) > 4]


class Labeller:
    """Labels spans by rules; streets, known words and places are taken from the texts given."""

    def __init__(self, texts: list[str], places: list[str] = []):  # noqa: B006
        names = sorted(streets(texts), key=len, reverse=True)
        street = "|".join(map(re.escape, names)) or "(?!)"
        self.address = re.compile(
            rf"\bblock\s\w+,?\s(?:depto\.?|departamento)\s\w+\sde\s(?:la\s|el\s)?(?:calle|pasaje|avenida|av\.)?\s?(?:{street})|{_STREET}(?<!\w)(?:{street}){_HOUSE}(?:,?\s(?:depto|dpto)\.?\s\w+)?"
            rf"|\b(?:calle|pasaje|avenida|av\.)\s(?:(?:los|las|el|la)\s)?{_STREET_WORDS}{_HOUSE}(?:,?\s(?:depto|dpto)\.?\s\w+)?",
            re.I,
        )
        words = Counter(w.lower() for t in texts for w in re.findall(r"[^\W\d_]+", t))
        self.given = {g.lower() for g in GIVEN}
        self.known = {w for w, n in words.items() if n >= max(40, len(texts) // 800)} - self.given
        ends: Counter = Counter()
        for t in texts:
            for a, b in re.findall(r"\b([A-ZÁÉÍÓÚÑ][^\W\d_]+)\s([A-ZÁÉÍÓÚÑ][^\W\d_]{5,})", t):
                if a.lower() in self.given and b.lower() not in self.known:
                    ends[b.lower()] += 1
        self.surnames = set(ends) - {w for p in places for w in p.lower().split()}
        tails = Counter(x[-6:] for x in self.surnames)
        self.surnames |= {w for w in words if w not in self.known and tails[w[-6:]] >= 4} - {w for p in places for w in p.lower().split()}
        self.place = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, places), key=len, reverse=True)) + r"|villa santa \w+|colegio san \w+|escuela \w+ \w+|hospital \w+ \w+)\b", re.I) if places else re.compile(r"\b(?:villa santa \w+|colegio san \w+|escuela \w+ \w+)\b", re.I)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        taken = [False] * len(text)
        found = []

        def take(a: int, b: int, kind: str) -> None:
            if b > a and not any(taken[a:b]):
                taken[a:b] = [True] * (b - a)
                if kind:
                    found.append((a, b, kind))

        for m in EMAIL.finditer(text):
            take(*m.span(), "email")
        for m in self.address.finditer(text):
            a = m.start() + len(m[0]) - len(m[0].lstrip())
            take(a, m.end(), "address")
        for m in self.place.finditer(text):
            take(*m.span(), "")
        for m in SPOKEN_DIGITS.finditer(text):
            first = m[0].lower()
            take(*m.span(), "id_number" if " guion " in first or first.startswith("cuatro") and not re.search(r"(?:fono|tel[eé]fono es|celular|whatsapp|ll[áa]meme al|de la casa),?\s*$", text[: m.start()], re.I) else "phone")
        for kind, rule in (("id_number", ID), ("phone", PHONE)):
            for m in rule.finditer(text):
                before = re.findall(r"\w+", text[: m.start()].lower())[-1:] or [""]
                if before[0] in NOT_PERSONAL or re.match(r"\s*(?:pesos|encuestas|kilómetros)", text[m.end() :]):
                    continue
                if kind == "id_number" and re.fullmatch(r"4\d{8}", m[0]) and not re.search(r"(?:rut|run|c[ée]dula|carnet|documento|identidad|di el|anotó)\W*(?:es|con|el)?\W*$", text[: m.start()], re.I):
                    continue
                take(*m.span(), kind)
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", text)]
        k = 0
        while k < len(words):
            a, b, w = words[k]
            low = w.lower()
            sn = lambda j: j < len(words) and text[words[j - 1][1] : words[j][0]] == " " and words[j][2].lower() not in self.known and len(words[j][2]) > 3
            if low in self.given and not (low == "paz" and w.islower() and text[:a].rstrip().endswith((" en", " la"))):
                end = b
                if sn(k + 1):
                    end, k = words[k + 1][1], k + 1
                    if sn(k + 1) and words[k + 1][2].lower() in self.surnames:
                        end, k = words[k + 1][1], k + 1
                take(a, end, "name")
            elif len(w) == 1 and w.isupper() and text[b : b + 1] == "." and k + 1 < len(words) and words[k + 1][0] - b <= 2 and words[k + 1][2].lower() not in self.known and len(words[k + 1][2]) > 3:
                take(a, words[k + 1][1], "name")
                k += 1
            elif low in self.surnames:
                end = b
                if sn(k + 1) and words[k + 1][2].lower() in self.surnames:
                    end, k = words[k + 1][1], k + 1
                take(a, end, "name")
            k += 1
        return sorted(found)


_SYLLABLES = [c + v for c in "b c d f g j l m n p r s t v z ch ll ñ qu tr br pl".split() for v in "aeiou"]
_ENDINGS = "ez ado era ino uela ente arra illo osa ún ía al ales anca eño entes ique edo ón ardo ín ruela belsique landera quilante ñestro bideño mearín zcarra nturín ldegas valejos riñuelas carrunza rejos".split()
# Forms that the tables have not, so that the model does not only know those that they have; # a digit, @ a capital letter, * a check digit.
MORE_PHONES = ["### ### ###", "## #### ####", "+## ### ### ###", "(##) #### ####", "####-####", "### ## ## ##", "+### #########", "0## ### ####", "##-###-####", "########", "+1 ### ### ####"]
MORE_IDS = ["########-*", "##.###.###-*", "###.###.###-##", "@@######", "@########", "##.###.###", "########@", "#.###.###-*", "@@@######"]
MORE_STREETS = ["camino ", "callejón ", "diagonal ", "alameda ", "paseo ", "costanera ", "Rua ", "Travessa ", "villa ", "pje. ", "Avda. "]
# How people bring up each kind; {} is the span.
FRAMES = {
    "name": "Me llamo {}.;Soy {}, de acá mismo.;Conversé harto con {}.;Eso lo ve {} con su equipo.;Está en casa de {}.;Mi hija ayuda a {}.;Gracias a {} salió todo.;La doctora {} me atendió.;La señora {} me ayudó.;Don {} no vino.;El que firmó fue {}.;Fuimos con {} a la feria.;Turno de {}, creo.;Preguntó por {} y nadie sabía.;Fui donde {} ese día.;Le habla {}.;Y {} qué dijo?;Ni {} lo sabe.;{} rechaza la encuesta.;{} valora el comedor común porque había confianza.;{} evita las visitas a domicilio por temporadas.;El profesor {} dijo que no.;Mi prima {} vive al lado.".split(";"),
    "email": "El correo es {}.;Me escribe a {}.;Mándelo a {} por favor.;Anote: {}.;A {} le llegó la invitación.;Quedó registrado {} en la ficha.".split(";"),
    "phone": "Mi teléfono es {}.;Fono {}.;Whatsapp {}.;Me dejó el celular, {}, y no contestó.;Llámeme al {} después de las seis.;El de la casa, {}.;Se ubica en el {}.".split(";"),
    "id_number": "Mi rut es {}.;RUN {}.;Cédula {}.;El carnet, {}.;Con el documento {} me inscribieron.;Le di el {} y listo.;La identidad es {}.;El pasaporte {}.;Documento {}.;Anotó {} en la hoja.".split(";"),
    "address": "Vivo en {}.;La casa queda en {}.;La carta llegó a {}.;Despachan a {}.;Me mudé a {}.;Era en {}, al lado del almacén.".split(";"),
    "": "También está {place}, que funciona en la sede.;Sin {place} no se habría logrado.;Caminamos dos cuadras hasta la plaza.;La calle principal se inunda siempre.;El pasaje estaba sin luz.;Eso quedó en el número de serie {d9}, nada más.;Ahí anotaron la planilla {d9}.;Revisamos el ticket {d8}.;Ahí anotaron el folio {d1}.{d3}.{d3}.;Eso quedó en el lote {d3}.{d3}.{d2}.;Eso quedó en el código de muestra 20{d2}-{d4}-33.;Un presupuesto de {d2}.{d3}.{d3} pesos.;Ahí anotaron el medidor {d1}-{d3}-{d3}.;La muestra P-{d3}, nada más.;La resolución {d3}-B.;La sala {d3}.;Casi {d3} kilómetros.;A las 8:{d2}.;El {d2}/{d2}/20{d2}.;Vivo cerca de la rotonda.;El señor del almacén no vino.;Vivíamos en paz, la verdad.;Hace dos o tres años, en la avenida.".split(";"),
}
_PLACE_KINDS = "Puerto Estero Cerro Villa Alto Caleta Población Programa Plan Red Mesa Beca Fondo Oficina Unidad Colegio_San Villa_Santa Hospital Escuela Liceo Fundación Junta Casa_del Centro".split()


class Inventor:
    """Invents personal data of every kind."""

    def __init__(self, seed: int, streets: list[str]):
        self.r = random.Random(seed)
        self.streets = streets or ["los alambiques menores"]

    def word(self, lo: int = 2, hi: int = 4) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(lo, hi)))

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def surname(self) -> str:
        return (self.word(1, 2) + self.r.choice(_ENDINGS)).capitalize()

    def given(self) -> str:
        x = self.r.random()
        if x < 0.75:
            return self.r.choice(GIVEN if x < 0.45 else MORE_GIVEN)
        return (self.word(1, 2) + self.r.choice("a o ina ino ela elo ando iana ín án ón isa ario eria el is és ita ito".split())).capitalize()

    def form(self, forms: list[str]) -> str:
        """One of the forms with each # a digit, each @ a capital letter and each * a check digit."""
        put = {"#": "0123456789", "@": "ABCDEFGHJKLMNPRSTUVXYZ", "*": "0123456789kK"}
        return "".join(self.r.choice(put[c]) if c in put else c for c in self.r.choice(forms))

    def name(self) -> str:
        x = self.r.random()
        if x < 0.3:
            return self.given()
        if x < 0.65:
            return f"{self.given()} {self.surname()}"
        if x < 0.8:
            return self.surname()
        return f"{self.r.choice('ABCDEFGHIJLMNOPRSTVYZÁÓ')}. {self.surname()}"

    def email(self) -> str:
        r = self.r
        words = "turno luna huerta sede casa coro pan gato barrio abuela ronda taller kiosco nido ventas lana contacto info luz mar sur norte azul verde nuevo chico tres".split()
        spoken = r.random() < 0.4
        sep = r.choice([" punto ", " guion ", " guion bajo ", ""] if spoken else [".", "-", "_", ""])
        local = sep.join([r.choice(words) if r.random() < 0.7 else self.word(), r.choice(words)]) + (self.digits(r.randint(1, 2)) if r.random() < 0.6 else "")
        domain = [r.choice(["buzon9", "mailsur", "casa", "vecinal", "postalia", "redcuidados", self.word(), "correo-norte", "sede-sur", "equipo.estudio"]), r.choice("example test invalid interno intranet com cl org".split())]
        if spoken:
            return f"{local} arroba {' punto '.join(domain).replace('.', ' punto ').replace('-', ' guion ')}"
        return f"{local}{r.choice(['@', '@', '@', ' @ ', ' (arroba) ', '[arroba]', ' arroba ', ' [at] ', ' [at] ', '[at]', ' (at) '])}{'.'.join(domain)}"

    def _say(self, digits: str) -> str:
        return self.r.choice([" ", ", "]).join(DIGIT_WORDS[int(d)] for d in digits)

    def phone(self) -> str:
        d = self.digits
        if self.r.random() < 0.3:
            return self.form(MORE_PHONES)
        return self.r.choice([lambda: f"+56 9 0{d(3)} {d(4)}", lambda: f"+999.{d(3)}.{d(4)}", lambda: f"0056-9-0{d(7)}", lambda: f"(0{d(1)}) 555 {d(4)}", lambda: f"555 {d(2)} {d(2)}", lambda: f"9-0{d(3)}-{d(4)}", lambda: f"90{d(7)}", lambda: self._say("90" + d(7)), lambda: self._say("90" + d(7))])()

    def id_number(self) -> str:
        d, k = self.digits, self.r.choice("0123456789kK")
        spoken = "ka" if k in "kK" else DIGIT_WORDS[int(k)]
        if self.r.random() < 0.3:
            return self.form(MORE_IDS)
        return self.r.choice([lambda: f"4{d(1)}.{d(3)}.{d(3)}-{k}", lambda: f"4{d(7)}-{k}", lambda: f"4{d(1)} {d(3)} {d(3)} guion {k}", lambda: f"0-4{d(3)}-{d(4)}", lambda: f"P-00{d(5)}", lambda: f"4{d(8)}", lambda: f"{self._say('4' + d(7))} guion {spoken}"])()

    def street(self) -> str:
        if self.r.random() < 0.5:
            return self.r.choice(self.streets).title().replace(" De ", " de ").replace(" Del ", " del ")
        return self.r.choice(["Los ", "Las ", "El ", "La ", ""]) + self.word().capitalize() + self.r.choice(["", " " + self.word().capitalize(), " del Norte", " de Piedra", " Altos", " Menores"])

    def address(self) -> str:
        r, d = self.r, lambda: str(self.r.randint(3, 3999))
        kind = r.choice(["calle ", "Av. ", "pasaje ", "avenida ", "", "calle "]) if r.random() < 0.75 else r.choice(MORE_STREETS)
        street = kind + self.street()
        return r.choice([lambda: f"{street} {d()}", lambda: f"{street} N° {d()}", lambda: f"{street} número {r.choice(SPOKEN_NUMBERS)}", lambda: f"{street}, casa {r.randint(1, 99)}", lambda: f"{street} #{d()}, depto. {r.randint(1, 99)}", lambda: f"{street} {d()}-{r.choice('ABC')}", lambda: f"block {r.randint(1, 9)} depto {r.randint(1, 99)} de la calle {self.street()}"])()

    def place(self) -> str:
        kind = self.r.choice(_PLACE_KINDS).replace("_", " ")
        return f"{kind} {(self.r.choice(GIVEN) if kind in ('Villa Santa', 'Colegio San', 'Escuela') and self.r.random() < 0.7 else self.word(2, 4).capitalize())}"

    def sentence(self, kind: str) -> tuple[str, list[tuple[int, int, str]]]:
        frame = self.r.choice(FRAMES[kind])
        if kind:
            a = frame.index("{}")
            span = getattr(self, kind)()
            if kind == "name" and self.r.random() < 0.12:
                span = span.upper()
            return frame.replace("{}", span), [(a, a + len(span), kind)]
        text = re.sub(r"\{d(\d)\}", lambda m: self.digits(int(m[1])), frame)
        return text.replace("{place}", self.place()), []

    def mixed(self, carrier: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        """A carrier with its spans and one or two invented sentences before or behind it, perhaps in lower case without marks."""
        text, found = carrier, list(spans)
        for _ in range(self.r.choice([1, 1, 2])):
            s, own = self.sentence(self.r.choices([*KINDS, ""], [2, 3, 3, 3, 6, 4])[0])
            if self.r.random() < 0.3:
                s, own = s[0].lower() + s[1:], own
            if self.r.random() < 0.5:
                found = own + [(a + len(s) + 1, b + len(s) + 1, k) for a, b, k in found]
                text = f"{s} {text}"
            else:
                found = found + [(a + len(text) + 1, b + len(text) + 1, k) for a, b, k in own]
                text = f"{text} {s}"
        return self.cased(text, found)

    def cased(self, text: str, found: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        x = self.r.random()
        if x < 0.2:
            inside = [False] * len(text)
            for a, b, _ in found:
                inside[a:b] = [True] * (b - a)
            keep = [k for k, c in enumerate(text) if inside[k] or c not in ",.;:¿¡!"]
            at = {k: n for n, k in enumerate(keep)}
            return "".join(text[k] for k in keep).lower(), [(at[a], at[b - 1] + 1, k) for a, b, k in found]
        return (text.upper(), found) if x < 0.22 and len(text.upper()) == len(text) else (text, found)
