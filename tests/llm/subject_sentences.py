"""Sentences written by hand for the test of subjects, apart from the test tables and from the terms."""

SENTENCES = {
    "software": """The function returns the wrong type when the array is empty.
Our build broke because someone merged an untested branch.
She rewrote the parser in a weekend.
The garbage collector pauses the program for seconds.
You need to compile the library before you link it.
A race condition corrupted the shared counter.
The API endpoint answers with invalid JSON.
Please open a pull request against the main branch.
The debugger stops at the wrong line.
We migrated the database schema without downtime.
The mobile app crashes on startup after the last release.
Unit tests now run on every commit.
This algorithm sorts the list in linear time.
The web server ran out of threads.
They forked the open source library.
Refactoring the module took three days.
Der Programmierer suchte den Fehler im Quellcode.
Die Datenbank antwortet seit dem Absturz nicht mehr.
El programador corrigió el código fuente.
La base de datos falla con dos errores.""",
    "security": """Hackers broke into the mail server last night.
The phishing mail asked for a password.
All traffic is encrypted with a fresh key.
An attacker could bypass the firewall.
The ransomware locked every laptop.
Two-factor authentication stopped the intruder.
A vulnerability in the login page was disclosed.
The penetration test found three holes.
Rotate the access token after the breach.
Malware hid inside the update.
The botnet flooded the site with requests.
Their private key was leaked on a forum.
Antivirus software missed the trojan.
The red team got in through a forgotten account.
Nobody changed the default password of the camera.
The audit log shows privilege escalation.
Der Angreifer nutzte eine Sicherheitslücke.
Das Passwort wurde bei einem Hackerangriff erbeutet.
El atacante robó las contraseñas.
Un programa malicioso cifró los discos.""",
    "law": """The judge dismissed the case.
Both parties signed the contract in March.
The plaintiff demands compensation for the breach of contract.
Her lawyer filed an appeal.
The court ruled that the clause was void.
A witness lied under oath and was charged with perjury.
The new statute takes effect in July.
The jury reached a verdict after two days.
They were sued for infringing a patent.
The regulation requires written consent.
His attorney advised him to settle.
The defendant pleaded not guilty.
Parliament passed the legislation by a narrow margin.
The licence clause limits our liability.
An injunction stopped the publication.
The notary certified the power of attorney.
Das Gericht hob das Urteil auf.
Die Anwältin reichte Klage ein.
La jueza dictó sentencia ayer.
El abogado presentó la demanda.""",
    "finance": """The bank raised interest rates again.
Quarterly revenue fell short of expectations.
Investors sold their shares in panic.
The invoice has to be paid within thirty days.
Her tax return was late.
The company took out a loan to cover the deficit.
Inflation ate up the savings account.
We exceeded the budget by ten thousand euros.
The auditor questioned the balance sheet.
Their dividend yields four percent.
The exchange rate hurts our profit margin.
The startup raised venture capital.
Mortgage payments rose in autumn.
The treasury issued new bonds.
Accounting booked the expense twice.
The hedge fund shorted the currency.
Die Bilanz weist hohe Schulden aus.
Der Zinssatz für Kredite steigt.
El banco concedió una hipoteca.
La inflación redujo los beneficios.""",
    "science": """The telescope captured a distant galaxy.
Researchers measured the spectrum of the isotope.
The enzyme breaks down the protein.
Physicists confirmed the particle with a new detector.
The experiment disproved the hypothesis.
Fossils of an unknown species were dug up.
The reaction needs a catalyst.
A comet will pass the planet in May.
Geologists drilled into the glacier.
The genome of the yeast was decoded.
Under the microscope the bacteria look like rods.
The control group showed no effect.
Electrons flow through the superconductor.
The chemist titrated the acid.
Black holes bend the light of stars.
Evolution explains the shape of the beak.
Die Forscher verglichen die Messwerte mit der Theorie.
Unter dem Mikroskop sah man das Erbgut.
Los científicos observaron una estrella.
El experimento confirmó la hipótesis.""",
    "health": """The patient complained of chest pain.
The surgeon operated for six hours.
The vaccine protects against the flu.
Her blood pressure dropped overnight.
The nurse changed the bandage.
Antibiotics did not help against the infection.
He was taken to hospital by ambulance.
The doctor prescribed a stronger dose.
Diabetes runs in the family.
The biopsy confirmed the diagnosis.
She had an allergic reaction to the medicine.
The midwife arrived in time.
Chemotherapy shrank the tumour.
The clinic was full of coughing children with fever.
The therapy eased his chronic pain.
An x-ray showed a fracture.
Die Ärztin stellte eine Diagnose.
Der Patient bekam ein neues Medikament.
La enfermera cuidó al paciente.
El médico recetó una vacuna.""",
    "logistics": """The container ship was stuck in the harbour.
The truck delivered twelve pallets.
Customs held the shipment for a week.
The forklift dropped a crate.
Our warehouse is out of space.
The courier lost the parcel.
Freight costs doubled on that route.
The supply chain broke down in spring.
Refrigerated goods must leave the depot by noon.
The driver missed the loading dock.
Inventory is counted every Friday.
The bill of lading lists forty boxes.
Goods are unloaded at the port terminal.
Trains carry most of the cargo.
The conveyor belt jammed again.
The haulier changed the delivery route.
Der Lkw stand drei Stunden am Zoll.
Die Pakete liegen noch im Lagerhaus auf Paletten.
El camión llevó la mercancía al almacén.
La aduana retuvo los paquetes.""",
    "people": """She asked her boss for a pay rise.
The company hired ten new employees.
He went on parental leave in June.
The job interview lasted an hour.
Our recruiter found two applicants.
Staff turnover is at a record high.
She quit because of unpaid overtime.
The works council rejected the shift plan.
Performance reviews take place in autumn.
He negotiated a better salary.
Remote work is allowed two days a week.
Her manager praised the whole team at the staff meeting.
The employer announced layoffs.
New hires get a mentor.
Burnout is common among our colleagues.
The vacancy has been open since May.
Der Mitarbeiter bat um mehr Gehalt.
Sie kündigte nach dem Urlaub.
El jefe contrató a dos empleados.
La empleada pidió vacaciones.""",
    "education": """The teacher corrected the essays.
Pupils learn to read in the first year.
The university raised its tuition fees.
She passed the final exam.
Homework is due on Monday.
The professor cancelled the lecture.
The curriculum now includes coding lessons.
He won a scholarship to college.
Students wrote a term paper on poetry.
The classroom was too small for thirty children.
Her dissertation took five years.
The school opens a new library wing.
Kindergarten children learn songs by heart.
The seminar starts next semester.
Parents met the headteacher.
He failed the spelling test at school.
Die Schüler schreiben eine Klausur.
Der Lehrer gab viele Hausaufgaben auf.
Los alumnos estudian para el examen.
La profesora explicó la lección.""",
    "sport": """The striker scored twice before half-time.
Our goalkeeper saved the penalty.
She ran the marathon in under three hours.
The team won the cup final.
The referee showed a red card.
He set a new world record in swimming.
The coach changed the line-up after the first game.
The tennis match went to five sets.
The cyclist crashed in the last lap.
Fans filled the stadium.
They lost the tournament on points.
The gymnast won a gold medal.
The boxer trained for the championship.
Our league table is led by a small club.
The rower missed the Olympics through injury.
The sprinter was tested for doping.
Der Torwart hielt den Elfmeter.
Die Mannschaft gewann das Turnier.
El delantero marcó el gol de la victoria.
El equipo ganó el campeonato.""",
}

NONE = """We had soup for lunch.
The lake froze in January.
He has a chip on his shoulder.
That meeting was a marathon.
Take his promises with a grain of salt.
The jury is still out on the new colour.
There is some chemistry between the two singers.
Her answer was textbook stuff.
It costs nothing to smile.
The old bridge was painted green.
My neighbour keeps bees.
They moved the sofa twice.
The note is still unanswered.
We will talk about it on Friday.
The wind came from the north.
Nobody keeps score among friends.
Das Wetter bleibt schön.
Er wohnt am See.
Mañana iremos a la playa.
La sopa estaba fría."""
