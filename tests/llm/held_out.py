"""Sentences written by hand with the names of private persons in them, to measure the model of persons.

[[name]] marks a private person; everything else is none, also judges, cited authors, organisations, towns and streets.

``SENTENCES`` were looked at while features and training phrases were chosen (several training runs, some phrases of the training text are
close to theirs), so they are a development set and its figures flatter the model. ``FRESH`` were written after the last training and
measured once: precision 0.80 (12 of 15 finds), recall 0.67 (12 of 18 mentions). No bound is tested on them.
"""

SENTENCES = """
La propietaria, [[Florencia Quiroga]], reclamó el pago de las expensas adeudadas desde marzo.
El perito contador tomó contacto con [[Hernán Bustos]] durante la inspección del local.
Según relató [[Camila Zabala]], el vehículo circulaba a gran velocidad por la ruta.
[[Gonzalo Ibarra]] negó haber recibido la carta documento que invoca la actora.
Llegado el día de la audiencia, no compareció [[Joaquín Etcheverry]] pese a estar notificado.
El juez Ricardo Lorenzetti disintió con la mayoría en ese punto.
La sentencia fue apelada por [[Rodrigo Navarrete]] y por la Aseguradora del Litoral S.A.
Su madre, [[Elvira Montenegro]], padece una enfermedad crónica y vive con el menor.
El contrato de locación fue firmado por [[Ezequiel Arce]] en la ciudad de Rosario.
Coincide con lo expuesto por Alterini en su conocida obra sobre la responsabilidad.
El testigo [[Facundo Leiva]] manifestó que vio salir a dos personas del comercio.
Los hermanos [[Valentina Ocampo]] y [[Benjamín Ocampo]] heredaron el inmueble por partes iguales.
La Cámara Nacional de Apelaciones en lo Civil confirmó el fallo de grado.
En Córdoba, el Banco Provincia otorgó un crédito hipotecario a [[Micaela Ferreyra]].
El accidente ocurrió en la esquina de Belgrano y Sarmiento, frente a la Municipalidad de Salta.
La doctora Elena Highton, vocal de la sala, votó en igual sentido.
Se ordenó embargar la cuenta de [[Leandro Villalba]] hasta cubrir el monto reclamado.
A fojas 45 obra el informe médico de [[Agustina Peralta]], quien refirió dolores lumbares.
El Hospital Italiano acompañó la historia clínica de la paciente [[Lorena Maidana]].
Con la declaración de [[Matilde Ayala]] quedó probado el pago parcial.
La empresa Transportes Andinos S.R.L. despidió sin causa a [[Damián Coria]].
El fiscal Julio Strassera solicitó el sobreseimiento.
[[Sabrina Toledo]], por derecho propio, promueve demanda contra la Clínica San Lucas.
El menor [[Thiago Roldán]] concurre a la escuela Domingo Faustino Sarmiento de Mendoza.
Fue citada [[Noelia Britos]], vecina del lugar, que dijo no recordar los hechos.
La Corte Suprema de Justicia de la Nación dejó sin efecto la resolución.
El vendedor entregó las llaves a [[Ulises Gallardo]] el mismo lunes.
Como señala Kemelmajer de Carlucci, el daño debe ser cierto.
El crédito fue cedido por [[Ivana Saavedra]] a favor de su cónyuge, [[Patricio Luna]].
[[LEDESMA, Rocío]] solicita la fijación de una cuota alimentaria.
Autos: "[[BARRIOS, NATALIO]] c/ Seguros del Plata S.A. s/ daños".
El colectivo conducido por [[Cristian Vega]] embistió a la peatona [[Delfina Moyano]].
El presidente del Consejo, Alberto Rojas, jueces y secretarios firmaron el acuerdo en La Plata.
Dispuso el pago a [[E. Cabrera]] en concepto de honorarios adeudados.
La señora [[Brenda Sosa]] y el señor [[Kevin Miño]] convivieron durante ocho años.
El departamento pertenecía a los sucesores de [[Hilario Paz]], fallecido en 1998.
Compareció la abuela paterna, [[Zulema Cáceres]], y pidió un régimen de visitas.
Los jueces Maqueda y Rosatti votaron en disidencia.
Notifíquese a la Dirección General de Rentas y al Registro de la Propiedad.
El comprador [[Emanuel Duarte]] depositó la seña en el Banco Nación, sucursal Tucumán.
""".strip().split("\n")

FRESH = """
Nadie discute que [[Melina Aguirre]] cumplía tareas de limpieza en el edificio.
Se encuentra acreditado el vínculo filial entre [[Ariel Quinteros]] y la niña.
Don [[Eusebio Carranza]] falleció sin dejar testamento.
La pericia caligráfica atribuye la rúbrica a [[Viviana Lescano]].
Cuando [[Maximiliano Funes]] abrió la puerta, el perro escapó.
Surge del expediente que [[Tamara Bazán]] abonó todas las cuotas.
La obligación alimentaria pesa sobre [[Orlando Taborda]].
Tanto [[Griselda Olmos]] como [[Rubén Olmos]] viajaron a Santa Fe.
El camarista Horacio Rosatti propició revocar la decisión.
La querella está encabezada por [[Nahuel Brizuela]].
El Colegio de Abogados de Jujuy informó la matrícula.
El cheque fue librado por [[Estefanía Godoy]] contra el Banco Patagonia.
Por su parte, [[Wenceslao Tapia]] guardó silencio.
La ambulancia trasladó a [[Jimena Arrieta]] al Hospital Rawson.
Borda y Llambías sostienen la tesis contraria.
Fue [[Osvaldo Crespi]] quien dio aviso a la compañía.
La tenencia compartida entre [[Paola Rey]] y [[Lisandro Heredia]] funciona bien.
El Juzgado de Familia de Chubut declinó su competencia.
Ninguna culpa cabe imputar a [[Fermín Echagüe]].
[[Candela Vera]] tenía catorce años al momento del hecho.
""".strip().split("\n")
