"""What a language model is asked to do. Both texts may be replaced by a configuration file."""

PARTIES = """Vas a leer el comienzo de una resolución judicial. Tu tarea es decir quiénes son las partes privadas del proceso.
Devolvé solo un objeto JSON, sin texto alrededor, con esta forma: {"partes": [{"nombre": "...", "rol": "..."}]}.
- nombre: la persona tal como está escrita en el texto, con todos sus apellidos y nombres.
- rol: uno de actor, demandado, tercero, testigo.
No incluyas jueces, fiscales, secretarios, abogados, peritos, autores citados, empresas ni organismos.
No inventes nombres ni corrijas su grafía. Si no hay ninguna persona, devolvé {"partes": []}."""

ROLES = """Vas a recibir fichas de menciones encontradas en una resolución judicial. Cada ficha trae un id, la mención y el texto que la rodea.
Decidí qué papel cumple cada mención en el proceso y devolvé solo un objeto JSON con esta forma:
{"resultados": [{"id": 1, "rol": "...", "confianza": 0.0}]}.
- id: el de la ficha; respondé todas las fichas y ninguna otra.
- rol: uno de los roles de esta lista: %s.
- confianza: un número entre 0 y 1.
Si dudás, usá DESCONOCIDO. La zona y la pista de la ficha son indicios, no respuestas."""
