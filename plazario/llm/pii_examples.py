"""Marked training sentences of the personal-information model: {kind|span}.  All content is invented."""

EXAMPLES = r"""
El recado es para Dña. {name|Ana Tobarrela}, que llega el jueves.
Warm wishes from all of us,\n{name|Emma Stroudwick}
Quedo a la espera,\n{name|Luis Zaldumbide Ferrán}
Herr {name|Udo Wessenrath} holt dich am Empfang ab. Ms {name|Claire Hathersedge} signs the papers.
Si hay prisa, {phone|+34 600 11 22 33}; si no, {email|ana.perez@buzon.test}.
Por las tardes contesto en el {phone|(+34) 611.22.33.44}; un abrazo, {name|Ana Robledo}
Para aclaraciones {phone|699112233}, a la atención de {name|Luis Cantero Mora}.
Centralita {phone|0034 622 334455}. La incidencia 4411-4411-20 sigue abierta. Pedido 7100-3300-42 enviado.
se la localiza en {phone|680.112233}. Actualiza a la versión 2.31.4455 cuanto antes.
El anuncio n.º 4012345678 caducó el 2026-05-02. Encuesta con 9123 participantes; p < 0.05.
Presupuesto de 512 345 euros al año. Salario entre 30.000 - 40.500 euros brutos. Factura 512 345 678 pagada.
Referencia B-12341234, factura F/2026/1234. Márgenes en píxeles: 12, 24, 48, 96.
Posting no. 4098765432 expired on 2026-03-04. Ticket 2200-2200-11 is still pending. Order 5500-1200-77 left.
Pay range: 34,000 - 44,500. A survey with 1234 people, p < 0.03. Release 2.44.1212 is out.
Desk line {phone|020 7946 0999}. After hours {phone|+44 20 7946 0111}. Freephone {phone|1-800-555-0142}.
Anything unclear? Dial {phone|(202) 555-0199}, extension two, for {name|Emma Whitlow}.
try her at {phone|202.555.0177}. mobile: {phone|+1-415-555-0123}
All the best,\n{name|Harold Penrose}\n{phone|+442079460333}
{name|J. Penrose}\n{phone|+34 655 443322}
Hasta pronto,\n{name|M. Robledo}\n{phone|(+34) 633.11.22.44}
DNI {ident|12345678Z}, a nombre de {name|Ana Robledo-Mora}
NIE {ident|X-1234567-L}; afiliación {ident|28/12345678/40}; en caso de accidente, avisad a {name|Luis Mora}.
presentó el carné {ident|12.345.678-Z} en la ventanilla.
Carné {ident|05 123 456 J}. permiso de residencia {ident|Y1234567X}.
Insurance number: {ident|QQ 12 34 56 C}. gave {ident|QQ123456A} and moved to {address|Flat 2, 18 Mill Street}.
The applicant, {name|Penrose, Emma}, gave {ident|987-65-4321} and moved to {address|12B Juniper Road}.
Assurée sous le {ident|1 84 12 75 123 456 78} depuis mars. Assuré : {ident|184127512345678}.
Beneficiario {ident|61/12345678/85}. Clave {ident|ROML850312MDFBRN08} del registro. Codice {ident|RSSMRA85T10A562S} valido.
Vivo en {address|Calle Mayor nº 12} y atiendo en el {phone|677889900}.
El portátil se entrega en {address|Pza. Fuente Seca, 14}. La plaza estaba vacía y la calle también.
Dejad el paquete en {address|Avenida los Pinos 80, 3.º B}. En esa avenida no se aparca.
Subid por {address|C/ Sauce 9, bajo dcha.} y llamad dos veces. La reunión es en {address|Carrer de Mallorca 77} a las seis.
la oficina de {address|Ronda Capitán Mora, n.º 11 - 2ºA} cierra en agosto. {address|Camino Molino 7}. {address|Avinguda del Port 31}, 2.
Come to {address|Flat 3, 17 Alder Close}, ring twice. Copper Hill Room has a screen.
parcels go to {address|98 Quarry Lane}. I moved to {address|11 Weaver's St.} and answer on {phone|+44 20 7946 0222}.
Frau {name|Birgit Lindner} wohnt {address|Lindenstraße 7a}. Herr {name|Lindner, Udo} zog in den {address|Ahornweg 12}.
Madame {name|Claire Dubreuil} habite {address|12 bis, rue des Lilas}. J'ai déjeuné avec {name|Marc Dubreuil}.
le colis part pour {address|44, avenue du Lac}. Renseignements : contact {name|Dubreuil, Marc}
A Dra. {name|Rita Sequeira} vive na {address|R. da Fonte, 65, 2.º esq.}. Almocei com {name|Sequeira, Rita} ontem.
entrega na {address|Travessa das Flores, 83}. Abraço,\n{name|Rui Sequeira}
Ms {name|Emma Penrose} chairs the panel. We had lunch with {name|Emma Penrose-Whitlow} and liked the plan.
Firma Dña. {name|Ana Mora} en {address|Plaza Vieja 1}. D. {name|Mora, Luis} no pudo venir. D. {name|L. Mora} tampoco.
Minutes taken for {name|PENROSE, EMMA} by the clerk. Cenamos con {name|ANA ROBLEDO MORA} anoche.
Según {name|Robledo, Ana}, falta presupuesto. Según {name|Ana de Robledo}, sobra.
La usuaria inventada, Ana, abre la app en el metro. El premio Robledo de cartelería se falla en mayo.
Estudio Robledo & Mora firma el cartel. Penrose & Whitlow Ltd drew the map. The invented user, Emma, reads at night.
El premio Ana Robledo cumple diez años. La sala Luis Mora tiene proyector. Room Emma Penrose is upstairs. Casa Ana Robledo S.L. vende azulejos.
Emma Penrose Ltd drew the map. The Emma Penrose Prize turns ten. Fundación Luis Mora beca a estudiantes.
{name|Emma Penrose}  Candidates bring a laptop. {name|Ana Robledo Mora} Traed el portátil cargado.
 {email|NPENROSE@BUZON.TEST} Laptops are provided. Nos veis en @taller_norte. Evita @import y @font-face en línea.
manda el libro a {email|rrhh (arroba) talento (punto) example} o a {email|jobs @ talento.example} cuando puedas.
Drop the files at {email|emma18 [at] hr [dot] example [dot] net} by noon. We post as @taller_norte too.
{name|Ana Robledo} — {phone|+34-638-112233} — {email|ana+libro @ example.org}
En copia, {email|seleccion.mora[at]equipo.example} y {email|lmora (at) talento (dot) example}.
We have been around for 45 years and like pets. Expect 23 chats. Demo on 2026-02-14 at 10:30.
Somos 28 en plantilla. Llevarás la app Belanto con gente de datos. El grupo tiene 79 clientes y 412 empleados.
The Rubara app is yours. Abalix and Irarix share a backend. Grupo Norte Talento atiende a pymes. Norte Talento Digital crece.
- good Spanish. Die App Kinara erscheint bald. Bei Bebaton planst du. Adobe Creative Suite y Google Analytics a diario.
Viriton y Sasuria comparten buscador. La app se llama Apinet Plus. Senior Product Designer wanted. Design System Lead wanted.
Rückfragen an {name|Lindner, Udo}, Durchwahl {phone|004930 23125777}. Zentrale {phone|+49 30 23125 11}. Fax {phone|(030) 23125 12}, Empfang {phone|030 / 23125-13}.
Cartão {ident|234 567 890} renovado. Pergunta por {name|Rita Sequeira}, {phone|920000111}. {name|Rui Sequeira}, {phone|(+351) 920-000-222}
Nos vemos,\n{name|Ana Mora}\n{phone|673729000}\nTraed agua. {name|Luis Mora}\n{phone|688 11 22 33}. {phone|644-11-22-33}
Steuer-ID: {ident|L01X00T47}. Pasaporte {ident|PAB123456}. Cartão {ident|12345678 1 ZZ4}. con carné {ident|12 345 678 k}
{name|Ana Mora} — {phone|677 889 900} Le logiciel Setura arrive. O programa Setura chegou.
Mr {name|John Smith} and Mrs {name|Alice Barnaby} wrote back. Señora {name|Zulema Arrizabalaga} preside. Don {name|Eladio Quintanapalla} firma.
Abrazos,\n{name|Jürgen Müller}\nVentas
Merci,\n{name|Solène Kerbriac}\nAtelier Bleu
We spoke with {name|Zbigniew Kowalczyk} about it. Reunión con {name|Nerea Uribarrieta}. Rufen Sie {name|Wolfram Katzenbach} an.
Hablamos con Recursos Humanos y con Grupo Telmaro. Trabajamos con Adobe Illustrator. Work with Product Owners and with Data Science.
Un equipo en Buenos Aires y otro en San Sebastián. New York Office. Reino Unido y Estados Unidos. Comunidad Valenciana.
Mr Product llega tarde. La Directora Creativa decide. El Equipo Digital crece. Prototyping And Research. User Experience Lead
Título Oficial\nJornada Completa\nDiseño Gráfico\nUX Writer\nProduct Designer\nHead Of Design\nQué Ofrecemos\nWhat We Offer\nTu Perfil\nPortal Empleo
Ms {name|Emma Halvergate} and {name|Ana Yebra-Solduga} came. Contact {name|Ulrike Sonnenfeld}, or write to Human Resources.
Ask for {name|Rita Vasconcelhos Pimentel}. Fala com {name|Rui do Casalinho}. Firmado: {name|Luis del Robledal Ibarreche}
Carné n.º {ident|345 678 912}, expedido en Lugo. Documento de identidade {ident|234 567 891}, emitido em Braga. Passaporte n.º {ident|456 789 123}.
Contacto: {name|Baltasar Sequeira Lagoalva}, planta tercera. Contact: {name|Quentin Penrose Aldwick}, third floor. Contact {name|Ottilie Lindner}.
Hubo relevo.\nEstudio Cantero & Sequeira pinta rótulos. Vuelve el verano. Estudio Lindner & Robledo dibuja mapas. Estudio Mora abre en mayo.
Signed, {name|Penrose, Emma} Last orders at nine. Firmado, {name|Cantero, Luis} Última hora. Signed, {name|Dubreuil, Claire}
Schöne Grüße,\n{name|Wendelin Achterberg}. Muchos saludos,\n{name|Idoia Garmendiaga}. Sincerely,\n{name|Tamsin Oakhanger}. Contact {name|Priya Ramanathan}.
Mit Grüßen,\n{name|Hartmut Brinkhoff}\nAbteilung Einkauf. Atentamente,\n{name|Nerea Lekuona}\nRecursos Humanos. Cordialement,\n{name|Maëlle Rouxel}
Ayer vino {name|ana robledo} con el presupuesto. Best of luck,\n{name|emma penrose}\n{phone|+44 20 7946 0777}. Da el visto bueno {name|cantero, luis}, como siempre. Mrs {name|claire dubreuil} agrees.
"""
