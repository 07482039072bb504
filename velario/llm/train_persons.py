"""Trains the weights of ``persons``: python -m velario.llm.train_persons TABLES_DIR.

Labels come from two sources. Sentences written here (``PERSON_LINES``, ``OTHER_LINES``) are filled with common names, names made by a rule
and organisations, towns and judges, so their labels are exact and owe nothing to the tables. At most ``MOST_TEXTS`` rulings of each table
are labelled where their surroundings are unambiguous. No name is a feature; context is dropped at random, so that form alone has to
carry a part of the decisions.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from math import log
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from . import persons, pii
from .cleanview import view

#: Bounds of the sample: rulings of each table, and sentences written here.
MOST_TEXTS, MADE = 2500, 40000
GIVEN = """Juan María José Ana Carlos Lucía Pedro Sofía Luis Laura Diego Paula Martín Elena Jorge Marta Pablo Rosa Andrés Inés Tomás Clara Hugo Irene Raúl Nora Sergio Alicia Víctor Julia Oscar Teresa
Daniel Silvia Mateo Emma Bruno Carla Iván Gloria Nicolás Mónica Felipe Sandra Germán Beatriz Lautaro Yolanda Simón Abril Ramiro Estela Omar Celeste Alan Luciana""".split()
SURNAMES = """García Pérez López Gómez Rodríguez Fernández Martínez Sánchez Romero Díaz Torres Álvarez Ruiz Ramírez Flores Acosta Medina Herrera Suárez Giménez Castro Molina Ortiz Silva Núñez Rojas Juárez
Cardozo Ríos Morales Domínguez Vázquez Figueroa Pereyra Cabral Rossi Bianchi Müller Petrov Smith Kowalski""".split()
ONSETS, TAILS = "b br c ch d f fr g gr j l ll m n p pr qu r s t tr v z".split(), "ada ano ante are aro asco ate azo edo ega elli ena era ero es eta ez iani ich ido illo ina ini ino o oni ora oso ot ovic ozo ués ui umi uya".split()
TOWNS = [t.replace("_", " ") for t in "Córdoba Rosario Mendoza Salta Tucumán Resistencia Posadas Neuquén Villa_María Río_Cuarto San_Juan Santa_Fe La_Rioja Bahía_Blanca Carlos_Paz Alta_Gracia Jesús_María".split()]
ORGS = """Banco Nación|Banco de Galicia|Aseguradora Federal S.A.|Transportes del Sur S.R.L.|Municipalidad de Morón|Cooperativa El Progreso Ltda.|Clínica Santa Isabel|Hospital Central|Seguros Rivadavia|Empresa Constructora Norte S.A.
Ministerio de Salud|Cámara de Apelaciones|Corte Suprema|Tribunal Superior de Justicia|Registro Nacional de las Personas|Provincia de Buenos Aires|Dirección de Tránsito|Sindicato de Empleados|Obra Social del Personal|Consorcio Edificio Mirador|Juzgado de Paz|Código Civil y Comercial|Ley de Contrato de Trabajo|Poder Judicial|Escuela Manuel Belgrano""".replace("\n", "|").split("|")
PERSON_LINES = """
El actor, {P}, reclamó una indemnización por los daños sufridos.
La demandada {P} contestó la demanda y negó los hechos.
{P} se presentó por derecho propio y promovió la acción.
{P} dijo que no conocía a la otra parte.
{P}, con patrocinio letrado, inició el juicio contra {O}.
Compareció {P} y declaró bajo juramento.
Fue oída la testigo {P}, quien vive en la casa lindera.
Los testigos {P} y {P} coincidieron en lo esencial.
La señora {P} y el señor {P} contrajeron matrimonio en {T}.
Según {P}, la obra estaba terminada en enero.
Según declaró {P}, el pago se hizo en efectivo.
Conforme los dichos de {P}, nunca hubo contrato.
El informe pericial sobre {P} fue agregado a la causa.
Se intimó a {P} a desalojar el inmueble.
Notifíquese a {P} en su domicilio real.
Se hace saber a {P} lo resuelto.
Corresponde condenar a {P} al pago de las costas.
El menor {P} permanece al cuidado de su abuela, {P}.
Su hija, {P}, estudia en {T}.
Su esposo, {P}, trabaja en {O}.
El hijo de {P} fue atendido en el {O}.
La historia clínica de {P} quedó reservada.
El rodado de {P} fue embestido por el de {P}.
El automóvil conducido por {P} circulaba por la avenida.
El inmueble fue vendido por {P} a {P} en el año 2005.
Los herederos de {P} iniciaron la sucesión.
La sucesión de {P} tramita en {T}.
{O} despidió a {P} sin expresar la causa.
{O} otorgó un préstamo a {P}.
La víctima, {P}, falleció en el acto.
El imputado {P} se negó a declarar.
La denunciante {P} ratificó su exposición.
El paciente {P} ingresó con fiebre.
La vecina {P} escuchó los gritos.
El recurso fue interpuesto por {P} y por {O}.
La apelación de {P} no puede prosperar.
Con la firma de {P} se cerró el acta.
Comparece {P}, con domicilio en calle {S} 44.
Presentóse {P}, y denunció el hecho.
{C} contra {P} s/ daños y perjuicios
Dato aportado por {P}, según acta.
A fojas 12 declara {P}, empleado de {O}.
A su turno, {P} pidió el rechazo de la demanda.
Al respecto, {P} explicó lo ocurrido.
Ayer llegó {P} desde {T}.
Entonces {P} llamó a la policía.
El letrado de {P} no concurrió.
En representación de {P} firmó su apoderado.
Vino luego {P} con los documentos.
{C} solicita el beneficio.
"{C} c/ {O} s/ daños y perjuicios"
"{C} c/ {C} s/ alimentos"
Autos caratulados: {C} contra {P} s/ cobro de pesos.
Firmado: {P}. Contacto: el de siempre.
Reclama {I} el pago de sus haberes.
El codemandado {I} adhirió a la contestación.
El comprador {P} y el vendedor {P} suscribieron el boleto.
La propietaria {P} alquiló el local a {P}.
Quien suscribe, {P}, ofrece prueba.
Don {P} y doña {P} son vecinos.
Se trata de {P}, jubilada, que padece diabetes.
El crédito de {P} fue verificado en el concurso de {O}.
Preguntado {P}, respondió que sí.
De la declaración de {P} surge lo contrario.
La cuota alimentaria a favor de {P} se fija en un tercio.
La guarda fue pedida por {P} para su nieto {P}.
""".strip().split("\n")
OTHER_LINES = """
El juez {N} votó en primer término.
La jueza {N} adhirió al voto.
Los jueces {N} y {N} votaron en igual sentido.
El doctor {N}, vocal de la sala, dijo que correspondía confirmar.
La señora vocal {N} dijo lo mismo.
El fiscal {N} dictaminó a fojas 30.
Ante mí, {N}, secretaria del juzgado.
Conf. {S}, Tratado de Obligaciones, tomo II.
Como enseña {S}, la culpa se presume.
Ver {S}, ob. cit., p. 40.
La doctrina de {S} es clara en este punto.
El voto del ministro {N} fue minoritario.
El presidente del tribunal, {N}, abrió el acto.
{O} contestó la citación en garantía.
La causa fue remitida a {O}.
El hecho ocurrió en {T}, cerca de la plaza.
Vivían en {T} y luego en {T}.
Vistos los antecedentes, la parte apeló.
Reunidos los requisitos, se hizo lugar al pedido.
Probados los hechos, cabe fijar la suma.
Reseñados los agravios, corresponde tratarlos.
Cumplidos los trámites, quedó firme.
Acompaña copia del documento y pide su agregación.
En la calle {S} 1234, piso 2, dpto. A, {T}. Sin perjuicio de ello, apeló.
Avenida {S} 55, {T}. Con fecha 3 de mayo se resolvió.
Pasaje {S} 820, piso 1, dpto. B, {T}. Vencido el plazo, se archivó.
La empresa de {T} cerró sus puertas.
Con domicilio en la ciudad de {T}.
Domiciliado en calle {S} 123, {T}.
Vecina de {T}, provincia de {T}.
El banco de {T} y la firma de {T} pagaron.
La calle {S} no tiene salida.
En la esquina de {S} y {S} hay un semáforo.
La avenida {N} fue cortada.
Se libró oficio a {O}.
El contrato fue celebrado entre {O} y {O}.
Considerando: Que la apelación es formalmente admisible.
Resulta de autos. Corresponde tratar los agravios.
Notifíquese, regístrese y archívese.
Ordenar el pago. Imponer las costas. Regular los honorarios.
Trabada la litis, se abrió la causa a prueba.
Asimismo, Corresponde señalar que el Código Procesal lo prevé.
Por ello, la Sala Segunda RESUELVE: Confirmar la sentencia.
En virtud del Decreto y de la Constitución Nacional.
El Poder Ejecutivo dictó la Resolución General.
Durante Enero y Febrero no hubo actividad en {T}.
La parte Actora y la parte Demandada apelaron.
El Departamento de {S} queda en la provincia.
""".strip().split("\n")


#: Words for frames: what stands before "de" and a name, what persons do, what persons are, and openings of sentences.
NOUNS = """la casa|la firma|el domicilio|la demanda|el escrito|el reclamo|los bienes|la madre|el padre|la hija|el hijo|la viuda|el abogado|la declaración|el testimonio|la culpa|la conducta|el vehículo|la moto|el sueldo|la deuda|la cuenta|el crédito
el legajo|la lesión|la muerte|el despido|la renuncia|los dichos|el poder|el recibo|la propiedad|el nombre|los derechos|la parte|el turno|la presencia|el pedido|la autoría|los herederos|el cónyuge|el hermano|la versión""".replace("\n", "|").split("|")
VERBS = """negó|afirmó|sostuvo|pidió|reclamó|cobró|pagó|firmó|vendió|compró|alquiló|denunció|reconoció|recibió|entregó|solicitó|expresó|aclaró|relató|insistió|trabajó|falleció|nació|vivió|condujo|manejaba|cruzaba|era|fue|es|estaba|tenía|padece|sufrió
declararon|dijeron|comparecieron|presentóse|presentáronse|comparece|negáronse|opúsose|vinieron|firmaron|promueve|interpuso|apeló|desistió|acompañó|ofreció|explica|vive|reside|acudió|llegó|salió|volvió|demandó|consintió|impugnó|adquirió|heredó|perdió|quedó|no compareció|no contestó|no probó|nunca pagó|se opuso|se agravia|se casó""".replace("\n", "|").split("|")
ROLES = """el actor|la actora|el demandado|la demandada|el testigo|la testigo|el señor|la señora|el menor|la niña|el joven|la víctima|el imputado|el acusado|la denunciante|el paciente|la clienta|el empleado|la trabajadora|el conductor|el peatón|la ciclista|el inquilino
la locadora|el deudor|la acreedora|el heredero|la causante|el garante|la fiadora|el vecino|la dueña|el socio|la esposa|el marido|la nieta|el abuelo|su hermano|su tía|su esposa|su padre|el dependiente|la compañera|el chofer|el encargado|la portera|los actores|las hermanas""".replace("\n", "|").split("|")
BEFORE = "por a de con contra para según sobre ante entre hacia y que también a/favor/de frente/a junto/a en/nombre/de respecto/de acerca/de por/parte/de".split()
RECEIVERS = "citó notificó intimó demandó condenó absolvió vio escuchó conoció encontró despidió contrató atendió ayudó embistió lesionó denunció indemnizó pagó llamó oyó".split()
REST = """en el año 2010|el lunes pasado|sin éxito|durante la audiencia|ante el juzgado|en la vía pública|con documentos|por escrito|en efectivo|según consta|a la tarde|frente a la plaza|en su descargo|sin justificar el motivo|desde entonces|una suma de dinero|la prueba ofrecida|los daños""".split("|")


def framed(rng: np.random.Generator) -> str:
    """A line put together from its words: a person, or in the same places an organisation, a town or the holder of an office."""
    pick = lambda xs: str(rng.choice(xs)).replace("/", " ")
    slot = "{P}" if rng.random() < 0.7 else "{O}" if rng.random() < 0.7 else "{T}"
    frames = [
        lambda: f"{pick(NOUNS)} de {slot} {pick(VERBS)} {pick(REST)}.", lambda: f"{slot} {pick(VERBS)} {pick(REST)}.", lambda: f"{pick(ROLES)} {{P}} {pick(VERBS)} {pick(REST)}.",
        lambda: f"{pick(ROLES)}, {{P}}, {pick(VERBS)} {pick(REST)}.", lambda: f"se {pick(RECEIVERS)} {pick(BEFORE)} {slot} {pick(REST)}.", lambda: f"{pick(REST)} {pick(VERBS)} {slot}.",
        lambda: f"{pick(REST)}, {slot} {pick(VERBS)} {pick(NOUNS)}.", lambda: f"{pick(ROLES)} {pick(RECEIVERS)} a {{P}} y a {{P}} {pick(REST)}.", lambda: f"{{P}} y {{P}} {pick(VERBS)} {pick(NOUNS)}.",
        lambda: f"{pick(ROLES)} {{P}} y {pick(ROLES)} {{P}} {pick(VERBS)} {pick(REST)}.", lambda: f"{pick(VERBS)} {slot} {pick(REST)}.", lambda: f"{{P}}, {pick(NOUNS)}, {pick(VERBS)} {pick(REST)}.",
        lambda: f"{pick(sorted(persons.OFFICES))} {{N}} {pick(VERBS)} {pick(REST)}.", lambda: f"{{N}}, {pick(sorted(persons.OFFICES))} de {pick(NOUNS)}, {pick(VERBS)}.", lambda: f"{pick(REST)} en {{T}} {pick(REST)}.",
        lambda: f"{pick(NOUNS)} fue {pick(['vendida', 'citado', 'firmada', 'hecho', 'resuelta'])} por {slot} {pick(REST)}.", lambda: f"{{C}} {pick(VERBS)} {pick(NOUNS)}.",
        lambda: f"como {pick(['enseña', 'señala', 'dice', 'explica', 'sostiene', 'postula', 'recuerda'])} {{S}}, {pick(NOUNS)} {pick(VERBS)}.", lambda: f"lo {pick(['dicho', 'expuesto', 'escrito', 'sostenido'])} por {{S}} en su {pick(['obra', 'tratado', 'comentario', 'manual'])} {pick(REST)}.",
    ]
    line = frames[int(rng.integers(len(frames)))]()
    return line[0].upper() + line[1:]


def made_name(rng: np.random.Generator) -> str:
    """A surname: a common one, or one made of syllables."""
    if rng.random() < 0.35:
        return str(rng.choice(SURNAMES))
    body = "".join(str(rng.choice(ONSETS)) + str(rng.choice(list("aeiou"))) for _ in range(int(rng.integers(1, 3))))
    return (body + str(rng.choice(list("bcdglmnrstvz"))) + str(rng.choice(TAILS))).capitalize()


def given(rng: np.random.Generator) -> str:
    if rng.random() < 0.25:
        return (str(rng.choice(ONSETS)) + str(rng.choice("a e i ia io".split())) + str(rng.choice("n l r nd s m".split())) + str(rng.choice("a o ía ina el án iel ea aro ia".split()))).capitalize()
    return str(rng.choice(GIVEN))


def sentence(line: str, rng: np.random.Generator, cast: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The line with its slots filled, and the spans of private persons. ``cast``: (given names, surname) of the persons of the text."""
    out, spans = "", []
    for part in re.split(r"(\{[A-Z]\})", line):
        if part in ("{P}", "{C}", "{I}"):
            g, s = cast[int(rng.integers(len(cast)))]
            shape = rng.random()
            text = {"{P}": f"{g} {s}" if shape < 0.7 else s if shape < 0.85 else f"{s.upper()}, {g}" if shape < 0.9 else f"{g} {s}".upper(), "{C}": f"{s}, {g}".upper() if shape < 0.7 else f"{s.upper()}, {g}", "{I}": f"{g[0]}. {s}"}[part]
            spans.append((len(out), len(out) + len(text)))
        elif part == "{N}":
            text = f"{given(rng)} {made_name(rng)}"
        elif part == "{S}":
            text = made_name(rng)
        elif part == "{T}":
            text = str(rng.choice(TOWNS))
        elif part == "{O}":
            text = str(rng.choice(ORGS))
        else:
            text = part
        out += text
    return out, spans


def made_texts(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts of three to eight sentences about a few persons."""
    rng, texts = np.random.default_rng(seed), []
    while n > 0:
        cast = [(given(rng) if rng.random() < 0.6 else f"{given(rng)} {given(rng)}", made_name(rng) if rng.random() < 0.85 else f"{made_name(rng)} {made_name(rng)}") for _ in range(int(rng.integers(1, 4)))]
        text, spans = "", []
        for _ in range(int(rng.integers(3, 9))):
            line = framed(rng) if rng.random() < 0.6 else str(rng.choice(PERSON_LINES if rng.random() < 0.65 else OTHER_LINES))
            s, at = sentence(line, rng, cast)
            spans += [(len(text) + a, len(text) + b) for a, b in at]
            text += s + str(rng.choice([" ", " ", "\n", "\n\n"]))
            n -= 1
        texts.append((text, spans))
    return texts


def main(tables: str, most: int = MOST_TEXTS, made: int = MADE) -> None:
    rng = np.random.default_rng(11)
    marked: list[tuple[list[persons.Node], list[int], float]] = []
    small: Counter[str] = Counter()

    def count(text: str) -> None:
        small.update(persons.fold(w) for w in set(re.findall(r"(?<![\w@._\-])[a-záéíóúüñ]{2,}(?![\w@_\-])", text)))

    for name, pages in (("pdf_documents", True), ("docx_documents", False)):
        for t in pq.read_table(f"{tables}/{name}.parquet", columns=["full_text"]).column(0).to_pylist()[:most]:
            if t:
                v, _ = view(t, pages)
                count(v)
                ns = persons.nodes(v, pii.structured(v))
                marked.append((ns, persons.labels(v, ns), 0.35))
    for t, spans in made_texts(made):
        count(t)
        ns = persons.nodes(t, pii.structured(t))
        marked.append((ns, [int(any(a <= n.start < b for a, b in spans)) for n in ns], 0.15))
    # a word that is often written in small letters is ordinary; those of names, as in addresses of mail, are not
    ordinary = frozenset(w for w, n in small.items() if n >= 4)
    labelled, same, skip = [], Counter(), Counter()
    for ns, ys, unclear in marked:
        seen: dict[str, int] = {}
        for k, (n, y) in enumerate(zip(ns, ys, strict=True)):
            if y >= 0:
                fs = n.features
                if rng.random() < unclear:  # unclear surroundings: form alone
                    fs = [f for f in fs if f[:2] not in ("l=", "r=", "m=", "q=")]
                if rng.random() < 0.5:  # most given names are in no list
                    fs = [f for f in fs if f not in ("given", "run_given")]
                labelled.append(([f for f in fs if f == "bias" or rng.random() > 0.2], y))
                if n.gap and k and ys[k - 1] >= 0:
                    same[persons.edge_type(ns[k - 1], n), ys[k - 1] == y] += 1
                if len(n.fold) >= 4:
                    key = persons.code(n.fold)
                    if key in seen:
                        skip[seen[key] == y] += 1
                    seen[key] = y
    edges = {t: max(-2.0, min(3.0, 0.5 * log((same[t, True] + 1) / (same[t, False] + 1)))) for t in {t for t, _ in same}}
    edges["skip"] = min(3.0, log((skip[True] + 1) / (skip[False] + 1)) * 0.5)
    model = persons.fit(labelled, edges, ordinary)
    print(len(marked), "texts,", len(labelled), "labelled words,", len(model.weights), "weights", edges)
    Path(__file__).with_name("persons_model.json").write_text(json.dumps({"weights": model.weights, "edges": edges}, ensure_ascii=False, indent=0, sort_keys=True))


if __name__ == "__main__":
    main(sys.argv[1])
