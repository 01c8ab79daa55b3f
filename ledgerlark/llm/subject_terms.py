"""Curated subject terms in English, German and Spanish, '|' between terms. STRONG ones weigh 1; WEAK ones, which other subjects
or plain speech use too, and VERBS weigh a half, so they carry a sentence only together with another of the subject."""

HALF = 0.5

#: Words and set phrases that one subject owns.
STRONG = {
    "software": (
        "feature flag|monorepo|bytecode|regex engine|heap allocator|garbage collector|borrow checker|linter|dependency|race condition|mutex|type checker|"
        "unit test|refactoring|parser|build pipeline|git branch|compiler|api endpoint|stack trace|pull request|cache layer|source code|software library|"
        "memory leak|test suite|programmbibliothek|schnittstelle|speicherleck|testlauf|quelltext|fuga de memoria|código fuente|biblioteca de software|"
        "rama de git|prueba unitaria|compilador|software|source file|programmer|programming language|programming|algorithm|debugger|debugging|debug build|"
        "runtime error|syntax error|null pointer|pointer arithmetic|hash map|hash table|linked list|binary tree|recursion|data structure|event loop|thread pool|"
        "deadlock|async function|web server|web framework|database schema|schema migration|sql query|database index|stack overflow|segmentation fault|segfault|"
        "memory allocator|virtual machine|docker|container image|kubernetes|continuous integration|version control|merge conflict|lock file|package manager|"
        "open source library|app store|mobile app|javascript|typescript|python script|rust crate|java class|command line tool|shell script|regular expression|"
        "code review|codebase|deployment pipeline|hotfix|release candidate|unit tests|integration test|regression test|static analysis|function signature|"
        "method call|subroutine|boolean|integer overflow|json parser|xml parser|rest api|graphql|microservice|operating system|kernel module|device driver|"
        "scripting language|type system|object oriented|functional programming|software engineer|software entwickler|softwareentwickler|programmierer|"
        "programmiersprache|datenbank|quellcode|übersetzer|kompilieren|fehlersuche|absturz|rückgabewert|abhängigkeit|versionsverwaltung|zweig zusammenführen|"
        "schnittstellen|datenstruktur|rekursion|bibliotheken|programador|programación|lenguaje de programación|base de datos|desarrollador|depurar|recompilar|"
        "algoritmo|función recursiva|puntero|desbordamiento|servidor web|código abierto|devuelve nulo|compilar"
    ),
    "security": (
        "salt and hash|nonce reuse|side channel|encryption key|sandbox escape|audit log|malware sample|certificate pinning|password rotation|penetration test|"
        "keylogger|replay attack|zero-day|attestation|firewall rule|honeypot|threat model|phishing mail|privilege escalation|access token|vulnerability|exploit|"
        "ransomware|passwortwechsel|zugriffsrecht|angreifer|schadsoftware|verschlüsselung|sicherheitslücke|atacante|cortafuegos|programa malicioso|cifrado|"
        "vulnerabilidad|contraseña|hacker|hackers|cyberattack|sql injection|cross-site scripting|buffer overflow|denial of service|botnet|malware|spyware|"
        "trojan|rootkit|backdoor|phishing|spoofing|data breach|stolen credentials|credentials|brute force|two-factor|multi-factor|authentication bypass|"
        "authorisation check|session hijacking|man in the middle|cipher|cipher suite|cryptography|cryptographic|private key|public key|signing key|"
        "signing secret|tls certificate|certificate authority|intruder|intrusion|intrusion detection|attacker|attackers|red team|blue team|pentest|"
        "security patch|security hole|security team|incident response|forensics|exfiltration|antivirus|quarantined file|password manager|leaked password|"
        "password hash|security audit|access control|least privilege|suspicious login|suspicious logins|hardening|bug bounty|exploit kit|patch the hole|"
        "stolen laptop|encrypted|decrypt|encryption|port scan|identity theft|hackerangriff|eindringling|einbruch ins netz|passwort|passwörter|signaturschlüssel|"
        "zugangsdaten|zweiten faktor|zwei-faktor|verschlüsselt|datenleck|sicherheitsloch|virenscanner|zertifikat|intruso|contraseñas|segundo factor|"
        "clave de firma|clave privada|ciberataque|pirata informático|cifrada|acceso no autorizado|fuga de datos|virus informático|hackeo|default credential|"
        "credential|default password"
    ),
    "law": (
        "jurisdiction|contract breach|statute|copyright notice|affidavit|licence clause|precedent|injunction|lien|estoppel|court ruling|probate|deposition|"
        "defendant|indemnity|regulation|plaintiff|subpoena|tort|liability|appeal|arbitration panel|lawsuit|berufung|klägerin|vertragsbruch|gerichtsurteil|"
        "haftung|gesetzentwurf|sentencia|contrato|responsabilidad civil|demandante|apelación|tribunal|lawyer|attorney|courtroom|supreme court|high court|"
        "court of appeal|district court|verdict|jury trial|prosecutor|prosecution|solicitor|legal counsel|legal advice|litigation|lawsuits|settlement agreement|"
        "testimony|perjury|sentenced|acquitted|convicted|conviction|felony|misdemeanour|custody battle|contract law|criminal law|civil law|constitutional|"
        "legislation|legislator|legislature|law firm|notary|patent|patents|trademark|copyright|intellectual property|licence agreement|non-disclosure agreement|"
        "data protection law|gdpr|consent form|contractual|breach of contract|legal dispute|arbitrator|mediation|magistrate|ombudsman|ministry fined|statutory|"
        "jurisprudence|power of attorney|executor of the will|disclaimer|legally binding|anwalt|anwältin|rechtsanwalt|richter|richterin|gericht|klage|urteil|"
        "vertrag|vertragspartei|vertragsparteien|gesetz|gesetze|einwilligung|staatsanwalt|zeugen|zeuge|urheberrecht|lizenz|rechtsstreit|patente|bußgeld|abogado|"
        "abogada|juez|jueza|juzgado|demanda|cláusula|consentimiento|fiscal|testigo|testigos|multa|licencia|litigio|derecho civil|firmaron las condiciones|"
        "delito|condena"
    ),
    "finance": (
        "hedge position|credit spread|escrow account|write-off|treasury bill|vat refund|accrual|dividend|liquidity buffer|cash flow|tax return|exchange rate|"
        "budget overrun|amortisation|loan|balance sheet|quarterly revenue|shareholder|invoice|bond yield|interest rate|stock market|payroll ledger|"
        "haushaltsplan|bilanz|wechselkurs|rechnung|steuererklärung|zinssatz|tipo de interés|dividendo|presupuesto|factura|balance contable|préstamo|"
        "bank account|bank loan|banker|mortgage|investor|investors|investment|shares fell|share price|stock price|stock exchange|pension fund|hedge fund|"
        "credit rating|credit card|interest payment|collateral|subsidy|subsidies|fiscal year|profit|profits|profit margin|revenue|revenues|turnover|expenditure|"
        "expenses|accountant|accounting|bookkeeping|audited accounts|auditor|auditors|income tax|tax authority|taxpayer money|vat|reimburse|reimbursed|"
        "reimbursement|travel costs|licence costs|inflation|prices rose|price increase|currency|devaluation|bankruptcy|insolvency|creditor|debtor|"
        "venture capital|dividends|annuity|savings account|central bank|monetary policy|budget cut|overspent|cost overrun|wire transfer|financial statement|"
        "financial|ledger balance|down payment|instalment|leasing rate|depreciation|preise|preiserhöhung|steuern|steuer|umsatz|gewinn|kredit|darlehen|konto|"
        "bank verlangt|sicherheiten|aktie|aktien|anleger|kosten stiegen|tausend euro|euro mehr|haushalt überzogen|zinsen|geldpolitik|schulden|buchhaltung|"
        "precios|impuestos|impuesto|ingresos|beneficios|ganancias|acciones|inversor|inversores|deuda|deudas|banco|garantías|mil euros|euros más|contabilidad|"
        "hipoteca|inflación|bolsa de valores"
    ),
    "science": (
        "neutrino|protein|laboratory sample|enzyme|catalyst|crystal lattice|experiment|isotope|tectonic plate|microscope|galaxy|telescope|titration|genome|"
        "mitochondrion|phylogeny|plasma density|hypothesis|spectrum|chemical reaction|electron|photon counter|erbgut|mikroskop|hypothese|versuchsreihe|"
        "katalysator|teilchen|proteína|experimento|hipótesis|microscopio|electrón|galaxia|scientist|scientists|physicist|physics|chemist|chemistry lab|"
        "biologist|biology|astronomer|astronomy|geologist|geology|botanist|zoologist|laboratory|lab sample|control group|placebo effect|molecule|molecules|"
        "proton|quantum|particle detector|particle accelerator|superconductor|semiconductor|alloy|solvent|reagent|polymer|yeast|bacteria|bacterium|fungus|"
        "ecosystem|fossil|fossils|evolution|natural selection|dna|rna|gene|genes|chromosome|cell division|photosynthesis|comet|asteroid|starlight|light from|"
        "supernova|black hole|gravitational|relativity|wavelength|spectrometer|laser beam|oscillation|thermodynamics|entropy|viscosity|glacier|volcano|seismic|"
        "earthquake|sediment|agree with theory|peer review|statistical significance|sample size|larger sample|experimental|observation of|lab rats|enzymes|"
        "wissenschaftler|forscherin|forscher|physik|chemie|biologie|messwerte|messung|messungen|licht des|legierung|säure|molekül|atome|gattung|theorie|labor|"
        "laborprobe|mäuse|bakterien|planeten|científico|científicos|científica|física|química|biología|mediciones|medición|teoría|estrella|estrellas|luz de la|"
        "aleación|ácido|molécula|especie|especies|laboratorio|ratones|bacterias|planeta|levadura"
    ),
    "health": (
        "fracture|anaesthetic|wound dressing|mri scan|biopsy|insulin pump|triage|immunity|cardiology ward|vaccine|infection|symptom|surgery|patient|"
        "prescription|dosage|blood pressure|clinic visit|dialysis|nurse shift|diagnosis|therapy|patientin|blutdruck|diagnose|impfstoff|krankenhaus|rezept|"
        "paciente|presión arterial|receta médica|vacuna|diagnóstico|hospital|doctor|doctors|surgeon|surgeons|physician|nurse|nurses|midwife|paramedic|hospitals|"
        "clinic|intensive care|emergency room|ambulance|ambulances|operating theatre|knee operation|operated on|transplant|chemotherapy|radiotherapy|antibiotic|"
        "antibiotics|painkiller|tablets twice|side effect|side effects|allergy|allergies|allergic|asthma|diabetes|cancer|tumour|tumor|stroke patient|"
        "heart attack|hypertension|cholesterol|fever|cough|flu|influenza|pneumonia|virus infection|epidemic|pandemic|vaccination|vaccinated|immune system|x-ray|"
        "ultrasound|mri|blood test|blood sample|intravenous|stitches|bandage|rehabilitation|physiotherapy|mental health|depression|anxiety disorder|"
        "psychiatrist|psychotherapy|dentist|toothache|pregnancy|pregnant|newborn|obesity|dietician|empty stomach|twice a day|medicine|medication|medications|"
        "pharmacy|pharmacist|illness|disease|diseases|chronic pain|dehydration|first aid|wounds|volunteers in the trial|arzt|ärzte|ärztin|krankenschwester|"
        "pflegerin|krankheit|krankenwagen|fieber|husten|grippe|zweimal täglich|nebenwirkung|nebenwirkungen|medikament|medikamente|apotheke|impfung|operation am|"
        "wunde|station im krankenhaus|patienten|allergie|médico|médicos|médica|enfermera|enfermero|enfermedad|ambulancia|fiebre|tos|gripe|dos veces al día|"
        "efecto secundario|efectos secundarios|medicamento|medicamentos|farmacia|vacunación|cirugía|cirujano|herida|pacientes|alergia"
    ),
    "logistics": (
        "cross-dock|conveyor|tare weight|cold chain|packing slip|inventory count|rail siding|barge|shipment|bill of lading|last-mile van|forklift|warehouse|"
        "demurrage|courier|delivery route|truck driver|loading dock|customs form|pallet|freight container|port terminal|lagerhalle|lieferroute|frachtcontainer|"
        "lastwagen|palette|zollformular|aduana|camión|contenedor|palé|ruta de reparto|almacén|logistics|lorry|lorries|truck|trucks|freight|freight train|"
        "freighter|container ship|cargo ship|shipping lane|shipped goods|shipments|delivery van|delivery driver|drivers sign|parcel|parcels|crate|crates|"
        "pallets|distribution centre|fulfilment centre|storage shelf|stockroom|stocktaking|out of stock|restock|restocking|supply chain|supplier lead time|"
        "lead time|customs|customs clearance|customs duty|import declaration|harbour|quay crane|perishable|refrigerated|rail freight|by rail|air freight|"
        "haulage|haulier|fleet of vans|route planning|tracking number|proof of delivery|consignment|consignments|consignee|packing station|returns pile|"
        "returned goods|order picking|picker|conveyor belt|loading bay|loading ramp|warehouses|stacker|barcode scanner|sticker|stickers|label printer|unloading|"
        "lkw|lastkraftwagen|spedition|fracht|ladung|ladefläche|laderampe|paket|pakete|lieferung|lieferungen|mit der bahn|liegeplatz|hafen|schiff wartet|zoll|"
        "versand|paletten|kühlkette|mercancía|mercancías|paquetes|paquete|furgoneta|buque|atraque|tráiler|camiones|en tren|aduanas|flete|muelle|envío|envíos|"
        "reparto|palés|inventario"
    ),
    "people": (
        "holiday request|headcount|parental leave|performance review|pay grade|probation|grievance|salary review|appraisal|burnout|works council|mentor|"
        "notice period|relocation package|team morale|exit interview|job interview|recruiter|sabbatical|job share|promotion round|onboarding week|"
        "bewerbungsgespräch|urlaubsantrag|gehaltsrunde|einarbeitung|elternzeit|betriebsrat|sueldo|vacaciones|ascenso|plantilla|permiso parental|"
        "entrevista de trabajo|human resources|hr department|employee|employees|employer|employers|former employer|staff turnover|workforce|colleague|"
        "colleagues|new hire|new hires|hiring|hired|hiring freeze|job applicant|applicant|applicants|job offer|job advert|vacancy|open position|open positions|"
        "cover letter|salary|salaries|wage|wages|pay rise|raise in pay|overtime|working hours|working from home|remote work|home office|part-time|full-time|"
        "shift work|night shift|on-call|day off|days off|sick leave|annual leave|holiday entitlement|maternity leave|paternity leave|resignation|resigned|"
        "dismissal|dismissed from his job|redundancy|laid off|layoff|layoffs|retirement|pension scheme|trade union|union representative|collective agreement|"
        "staff meeting|team building|career path|promoted to|appraisals|feedback talk|line manager|his boss|her boss|workplace|mobbing|harassment at work|"
        "mentoring|mentorship|apprentice|internship|work-life balance|employee survey|onboarding|mitarbeiter|mitarbeiterin|angestellte|arbeitgeber|arbeitszeit|"
        "gehalt|gehälter|lohn|löhne|prämie|kündigung|kündigte|urlaub|freie tage|offene stellen|stellenanzeige|bewerber|bewerberin|bewerbung|personalabteilung|"
        "bereitschaftsdienst|bereitschaftsdienstes|homeoffice|überstunden|beförderung|kollegin|kollege|empleado|empleados|empleada|jefe|jefa|sueldos|salario|"
        "salarios|contratación|vacantes|candidato|candidatos|renunció|renunciaron|días libres|guardias|horas extra|despido|baja por|recursos humanos|compañera|"
        "jornada laboral|teletrabajo"
    ),
    "education": (
        "dissertation|faculty senate|literacy rate|syllabus|report card|enrolment|pedagogy|seminar|lecture|spelling bee|invigilator|school term|curriculum|"
        "scholarship|kindergarten|exam grade|homework|tutor|classroom|student essay|textbook|teacher|vorlesung|unterricht|lehrplan|hausaufgabe|zeugnis|"
        "schülerin|alumno|profesora|deberes|plan de estudios|aula|beca|schools|schooling|pupil|pupils|student|students|university|universities|college|campus|"
        "professor|professors|lectures|teachers|teaching|teaching staff|headteacher|schoolmaster|class test|classrooms|exams|examination|diploma|"
        "bachelor's degree|master's degree|doctoral thesis|thesis|phd|freshman|freshmen|undergraduate|undergraduates|graduate school|alumni|tuition|tuition fee|"
        "scholarships|learner|learners|learning goal|beginners' course|evening class|distance learning|e-learning|trainee|trainees|vocational training|"
        "curricula|syllabi|textbooks|chapter exercise|essays|spelling|arithmetic|multiplication table|reading aloud|literacy|primary school|secondary school|"
        "high school|nursery school|parents complained|parents' evening|school holidays|term paper|homeworks|plagiarism|semester|schule|schulen|schüler|"
        "schülerinnen|studierende|studenten|studentin|universität|hochschule|professorin|lehrer|lehrerin|lehrkraft|klausur|bestanden|stunden in|klassenzimmer|"
        "erstsemester|abschluss|diplom|lernende|ausbildung|escuela|escuelas|colegio|instituto|alumnos|alumnas|estudiante|estudiantes|universidad|profesor|"
        "profesores|maestra|maestro|examen|exámenes|aprobaron|nota media|padres se quejaron|primer curso|lección|lecciones|aprendices|tesis|asignatura"
    ),
    "sport": (
        "peloton|offside trap|podium|tennis match|marathon|javelin|scrum|training camp|slalom|penalty kick|goalkeeper|stadium|regatta|relay team|bouldering|"
        "league table|free throw|coach|cup final|referee|tournament|turnier|tabellenplatz|trainerin|elfmeter|torwart|portero|entrenadora|torneo|liga|maratón|"
        "penalti|football|footballer|soccer|rugby|cricket|basketball|volleyball|handball|hockey|baseball|golf|tennis|badminton|swimming|swimmer|athlete|"
        "athletes|athletics|sprinter|gymnast|gymnastics|cyclist|cyclists|cycling race|rowing|rower|rows against|boxing|boxer|wrestling|skiing|skier|snowboard|"
        "ice hockey|figure skating|climbing wall|olympic|olympics|world cup|championship|championships|second division|promotion play-off|semi-final|"
        "quarter-final|final whistle|third goal|own goal|midfielder|defender|goalkeepers|captain of the team|penalty shoot-out|red card|yellow card|injury time|"
        "lap time|lap times|personal best|record time|world record|club record|medal|gold medal|trophy|match point|set point|tie-break|lost the set|won the set|"
        "scorer|score twice|kick-off|pitch invasion|stadiums|coaches|training session|transfer window|referees|umpire|doping|hurdles|high jump|long jump|"
        "pole vault|five-a-side|dribble|fußball|fußballer|spieler|spielerin|mannschaft|stürmer|dritten tor|bestzeit|läufer|läuferin|rennen|weltmeister|"
        "meisterschaft|trainer|stadion|schiedsrichter|schwimmer|medaille|fútbol|futbolista|jugador|jugadora|jugadores|equipo ganó|delantero|gol|goles|"
        "tercer gol|hinchas|carrera|carreras|campeonato|campeón|medalla|tiempo récord|estadio|árbitro|entrenador|nadador|ciclista"
    ),
}

#: Words that suggest a subject.
WEAK = {
    "software": (
        "callback|middleware|frontend|backend|interpreter|repository|rollback|refactor|recompile|compile|klammer|variable|variables|llaves|corchetes|bug|bugs|"
        "crash|crashes|build|builds|test|tests|code|commit|branch|merge|deploy|deploys|version|release|function|functions|library|module|compiled|null|"
        "returns null|input|frame|braces|promise|scripts|server|patch|loop|string|array|klammern|zurück|liste zurück|quelle|versión|prueba|pruebas|rama|nulo|"
        "errores|fehler|rename|renamed|panics|quadratic|iterates|language|decode|rerun|prüfung|prüfungen|zusammenführen|stürzt|abstürzt|laufen alle|falla|"
        "anidadas|fusionar|ejecutar"
    ),
    "security": (
        "gestohlen|angriff|robado|leak|leaked|blocked|backup port|login|logins|login page|secret|secrets|port|stolen|laptop|rotate|rotated|threat|hole|trusts|"
        "caller|suspicious|firewall|signing|pasted|zugriff|schlüssel|clave|acceso|bloqueado|anmeldung|unauthorised|alarm|monitoring|token|tokens"
    ),
    "law": (
        "judge|judges|barrister|counsel|sued|sue|witnesses|warrant|bail|obligation|clause|clauses|fine for|paragraph|strafe|ley|leyes|partes contratantes|court|"
        "trial|legal|law|laws|contract|contracts|parties|party|signed|terms|forbid|forbids|permitted|consent|withdrawn|lapses|case|cases|fined|fine|ministry|"
        "notice|records|rights|signature|wording|bound by|heard|dismissed|holds the patent|beide parteien|fall|parteien|unterschrieben|bedingungen|abgewiesen|"
        "caso|partes|firmaron|condiciones|retirarse|desestimó|prohibir|ministerio"
    ),
    "finance": (
        "bond|bonds|debt|debts|deficit|surplus|equity|portfolio|gastos|moneda|bank|banks|tax|price|prices|costs|cost|money|budget|euros|dollars|thousand|"
        "percent|margin|cash|pay back|payment|payments|market|income|sold|quarter|fiscal|planned|licences|spread|auditors asked|expense|cover|covers|kosten|"
        "geld|euro|preis|dinero|coste|costes|precio|mercado|por ciento|planeado|previsto|pide|verlangt|geplant|stiegen|subieron"
    ),
    "science": (
        "atom|atoms|particle|acid|acids|species|orbit|planet|planets|gravity|climate model|measurement|measurements|theory predicts|replication|replicate|"
        "replicating|reproducible result|mice|ponds|stern|sterne|arten|tierart|theory|sample|samples|experiment on|light|star|stars|sun|moon|effect|effects|"
        "paper|results|measured|detector|dissolved|coating|temperature|conducting|degrees|strain|strains|group of|bends|found in|vanished|energy|mass|cell|"
        "cells|nature|research|researcher|researchers|hypotheses|probe|wirkung|forschung|temperatur|muestra|efecto|investigación|temperatura|grados|concuerdan|"
        "übereinstimmen|leiten|sequenced|kelvin"
    ),
    "health": (
        "ward|wards|drip|wound|casos de|pain|symptoms|treatment|treated|dose|doses|pill|pills|trial|care|healthy|health|sick|ill|recovery|recovered|blood|"
        "bleeding|skin|knee|heart|lungs|stomach|with food|volunteers|appeared|cases|remind|reminds|schmerzen|behandlung|blut|täglich|essen|fälle|gesund|dolor|"
        "tratamiento|sangre|comida|salud|casos|estación|enfermo"
    ),
    "logistics": (
        "counts|counted|trailer|cargo|shipping|depot|inventory|docks|berth|crane|goods|packaging|shelves|lager|fahrer|kisten|waren|carga|puerto|conductores|driver|drivers|"
        "ship|ships|train|van|vans|box|boxes|stock|late|half empty|empty|sign for|tablet|route|routes|label|labels|delivery|deliveries|delivered|transport|"
        "arrive|arrived|arrives|waits|heavy|kilos|tons|ramp|returns|blue boxes|free berth|rail|schiff|kam|wartet|fahren|bahn|lieferte|llegó|espera|tren|barco|"
        "entregas|entrega|almacenes"
    ),
    "people": (
        "staff|bonus|quit|career|promotion|boss|intern|prima|team|manager|leave|pay|job|jobs|work|working|worked|hours|shift|shifts|hire|birth|expected of|"
        "raised|keep the|feedback|rota|shadows|steward|new colleague|morale|contract ended|stelle|stellen|arbeit|arbeiten|tage|chef|geburt|trabajo|trabajar|"
        "turno|equipo|puesto|puestos|días|ningún|nacimiento|libres|half-time"
    ),
    "education": (
        "school|lecturer|lesson|lessons|exam|marks|grades|graded|course|essay|quiz|noten|eltern|klasse|kurs|clases|padres|curso|cursos|learn|learns|learned|"
        "read|reading|test|passed|failed|hand in|work|chapter|repeat|repeats|proof of|skill|skills|summer|kept apart|weaker|helps|certificate|teach|taught|"
        "study|studies|parents|beginners|closes for|class|classes|complained|lernen|lernt|stunden|sommer|schließt|bestehen|verano|cierra|aprender|quejaron|"
        "aprobar|enseñar|trabajos|prüfung|prüfungen|diploma"
    ),
    "sport": (
        "league|goal|goals|striker|penalty|lap|aces|scored|fans|race|races|relay|nil|injured|tor|tore|verletzt|lesionado|match|matches|game|games|team|win|wins|"
        "won|lost|beat|beats|score|scores|second place|third place|first place|place|points|run|runs|runner|runners|ran|jump|ball|kick|heat|record|rows|"
        "left early|bench|until the autumn|behind the hall|training|club|clubs|season|spiel|spiele|gewonnen|verloren|platz|meter|meter in|herbst|fällt aus|"
        "partido|partidos|ganó|perdió|jugar|metros|otoño|hasta otoño|récord|temporada|half-time"
    ),
}

#: What things of a subject do.
VERBS = {
    "software": (
        "deserialises|throws inside|deadlocks with|compiles against|refactored around"
    ),
    "security": (
        "hardens|exfiltrates|spoofs|encrypts|leaks through|brute-forced via"
    ),
    "law": (
        "infringes|indemnifies|overturns|litigates|ratifies|barred under|testifies on"
    ),
    "finance": (
        "depreciates|underwrites|devalues|refinances|booked against"
    ),
    "science": (
        "diffracts|oxidises|orbits|catalyses|irradiated by|correlates with|mutates under"
    ),
    "health": (
        "inflames|aggravates|vaccinates against|sterilises|prescribed with"
    ),
    "logistics": (
        "hauls|unloads|restocks|consigns|palletised beside|detours around"
    ),
    "people": (
        "onboards|mentors|reprimands|resigns over|hires for|interviewed about"
    ),
    "education": (
        "teaches|plagiarises|graded on|enrols in|revises for|graduates from|lectures on"
    ),
    "sport": (
        "outruns|tackles|substituted for|scores against|sprints past|dribbles around"
    ),
}

#: Idioms and set phrases: the longer match hides a term inside.
FIGURES = (
    "grain of salt|pinch of salt|slam dunk|was a marathon|not a sprint|school of thought|old school|teach him a lesson|learned my lesson|"
    "the jury is still out|jury is out|day in court|court of public opinion|ball is in|not a court|courting|textbook answer|textbook case|textbook example|"
    "by the book|health check|clean bill of health|sick and tired|rather sick of|sick of it|sick of|bitter pill|just what the doctor ordered|"
    "taste of their own medicine|under the weather|shot in the arm|floodgates|keeps score|keep score|keeping score|settle a score|knows the score|"
    "some chemistry|chemistry between|rocket science|litmus test|under the microscope|quantum leap|black hole of|pedigree|give it credit|give credit|"
    "to their credit|credit where|cash in on|pay attention|pay a visit|pays off|pay off|costs nothing|at all costs|price to pay|bank on it|can bank on|"
    "money talks|laugh all the way to the bank|the bottom line|take stock|takes stock|in stock form|low stock of patience|kick the can|kick off the meeting|"
    "move the goalposts|own goal of|level playing field|out of our league|in a league of|home run|par for the course|of course|in due course|on course|"
    "race against time|rat race|throw in the towel|hit the ground running|drop the ball|jump the gun|down to the wire|ship it|that ship has sailed|"
    "jump ship|run a tight ship|abandon ship|package deal|pushing the envelope|off the rails|train of thought|missed the boat|a bug in the wording|bug bear|"
    "bug me|patch things up|patch it up|the proof is left|proof of the pudding|let it rest|give it a rest|back to square one|key point|key to success|"
    "the root of|run it by|pitch the idea|elevator pitch|lame excuse|charge against|in charge of|lay down the law|law of averages|murphy's law|"
    "above the law|open secret|worst kept secret|red flag|smoking gun|double-edged|last straw|no quarter|third party|party line|spielt keine rolle|"
    "schule machen|macht schule|auf dem spiel|am ball bleiben|in kauf nehmen|auf eigene kosten|auf kosten|arzt verordnet|recht haben|de primera clase|"
    "hacer escuela|salud y suerte|costar un ojo|costa de|a toda costa|en juego|fuera de juego político|dar crédito|cuenta con|tener en cuenta|darse cuenta|"
    "de ley|por ley de vida"
)
