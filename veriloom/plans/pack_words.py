"""What the built-in packs know a question by, as tables of their own."""

from __future__ import annotations

# Beginnings of words, by pack, in English and Polish.
KEYWORDS = {
    "medicine": """
    vitamin; witamin; supplement; suplement; dose; dawk; disease; chorob; patient; pacjent; clinical; klinicz; therapy; terapi; treatment; leczen; risk;
    ryzyk; mortality; śmiertel; infection; infekc; diet; nutrition; żywien; cancer; nowotw; drug; leków; lekar; symptom; objaw; health; zdrow; deficiency;
    niedob; omega; probiotic; probiotyk; magnesium; magnez; iron; żelaz; zinc; cynk; blood; krew; vaccine; szczepi; pregnan; ciąż; sleep; insomnia;
    bezsenn; creatine; kreatyn; caffeine; kofein; cholesterol; diabetes; cukrzyc; obesity; otyło
    """,
    "psychology": """
    psycholog; behavio; zachowan; cognitive; poznawcz; memory; pamięć; attention; uwag; anxiety; lęk; depress; motivation; motywac; personality; osobowoś;
    learning; uczenie się; education; edukac; student; habit; nawyk; stress; stres; wellbeing; dobrostan; mindfulness; social media; media społeczn;
    procrastinat; prokrastyn; self-esteem; samoocen; bias; heurystyk
    """,
    "cs_ai": """
    algorithm; algorytm; neural; neuron; machine learning; uczenie maszyn; deep learning; llm; language model; model język; transformer; benchmark;
    dataset; zbiór danych; nlp; computer vision; reinforcement; software; oprogramow; compiler; kompilator; database; baza danych; distributed;
    rozproszon; security; bezpieczeńst; cryptograph; kryptograf; retrieval; rag; embedding; gpu; inference; fine-tun; agent; prompt; hallucination;
    halucynac; graph neural; classification; klasyfikac
    """,
    "engineering": """
    engineering; inżynier; material; materiał; fatigue; zmęcz; stress; naprężen; strength; wytrzymał; composite; kompozyt; steel; stal; concrete; beton;
    alloy; stopy metal; weld; spaw; turbine; turbin; battery; bateri; akumulator; solar; fotowolt; circuit; obwód; sensor; czujnik; manufactur; produkc;
    additive; druk 3d; 3d print; thermal; termicz; aerospace; lotnic; structural; konstrukc; hydrogen; wodór; motor; silnik; corrosion; korozj; bridge;
    mosty; power grid; sieć energet; control system; sterowan; vibration; drgan
    """,
    "physics": """
    quantum; kwant; particle; cząstk; dark matter; ciemna materia; galaxy; galakty; star; gwiazd; cosmolog; kosmolog; black hole; czarna dziura; neutrino;
    higgs; lhc; superconduct; nadprzewod; laser; photon; foton; gravitation; grawitac; exoplanet; egzoplanet; telescope; teleskop; plasma; plazm;
    condensed matter; spin; relativ; relatywist
    """,
    "chemistry": """
    compound; związek; molecule; cząsteczk; reaction; reakcj; synthesis; synteza; catalyst; katalizator; polymer; polimer; solubility; rozpuszcz;
    toxicity; toksyczn; molecular; molekular; chemical; chemicz; enzyme; enzym; oxidation; utlenian; pka; ph ; spectroscop; spektroskop; chromatograph;
    chromatograf; electrolyte; elektrolit
    """,
    "economics": """
    economy; gospodar; economic; ekonom; inflation; inflacj; gdp; pkb; unemployment; bezroboc; wage; wynagrodz; płac; interest rate; stop procent;
    monetary; monetar; fiscal; fiskal; tax; podat; market; rynek; rynk; finance; finans; stock; akcj; investment; inwestyc; trade; handel; tariff; cło;
    policy; polityk; minimum wage; płaca minimal; housing; mieszkan; pension; emerytur; productivity; produktywn; poverty; ubóstw; inequality; nierówn
    """,
    "climate": """
    climate; klimat; emission; emisj; carbon; węgl; co2; warming; ocieplen; temperature; temperatur; biodiversity; bioróżnorod; ecosystem; ekosystem;
    pollution; zanieczyszcz; smog; air quality; jakość powietrza; sea level; poziom morza; drought; susz; renewable; odnawial; deforestation; wylesian;
    ocean; glacier; lodowc; methane; metan; environment; środowisk
    """,
    "law_pl_eu": """
    ustaw; kodeks; prawo; prawa; przepis; rozporządzen; dyrektyw; sąd; wyrok; orzecz; uchwał; trybunał; art.; artykuł; konsument; umow; odpowiedzialnoś;
    rodo; gdpr; law; statute; court; judgment; regulation; directive; legal; liability; contract; eu law; tsue; cjeu; abuzyw; klauzul; niedozwolon;
    postanowien; nieważnoś; roszczen; pozew; pozwan; kasacj; apelacj; rękojm; najm; spadk; frankow; kodeks cywil; k.c.; k.p.; rodo; odszkodow
    """,
}

# Fields of research, by pack.
FIELDS = {
    "medicine": """
    Medicine; Nursing; Health Professions; Pharmacology, Toxicology and Pharmaceutics; Immunology and Microbiology; Biochemistry, Genetics and Molecular
    Biology; Dentistry; Neuroscience
    """,
    "psychology": """
    Psychology; Social Sciences; Neuroscience; Arts and Humanities
    """,
    "cs_ai": """
    Computer Science; Mathematics; Decision Sciences
    """,
    "engineering": """
    Engineering; Materials Science; Energy; Chemical Engineering; Physics and Astronomy
    """,
    "physics": """
    Physics and Astronomy; Earth and Planetary Sciences
    """,
    "chemistry": """
    Chemistry; Chemical Engineering; Pharmacology, Toxicology and Pharmaceutics; Materials Science
    """,
    "economics": """
    Economics, Econometrics and Finance; Business, Management and Accounting; Social Sciences; Decision Sciences
    """,
    "climate": """
    Environmental Science; Earth and Planetary Sciences; Agricultural and Biological Sciences; Energy
    """,
    "law_pl_eu": """
    Social Sciences; Business, Management and Accounting
    """,
}

# Venues that add to a weight, by pack.
VENUES = {
    "cs_ai": """
    NeurIPS; Neural Information Processing Systems; ICML; International Conference on Machine Learning; ICLR; ACL; EMNLP; NAACL; CVPR; ICCV; ECCV; AAAI;
    IJCAI; KDD; SIGIR; WWW; The Web Conference; OSDI; SOSP; NSDI; USENIX Security; IEEE S&P; Symposium on Security and Privacy; CCS; CHI; STOC; FOCS;
    SODA; PLDI; POPL; ICSE; FSE; VLDB; SIGMOD; JMLR; TPAMI; Transactions on Machine Learning Research
    """,
}

# What screening does by default, in every pack.
SCREENING = {"auto_exclude_retracted": True, "auto_exclude_designs": []}


def listed(text: str) -> list[str]:
    """The entries of a table's text, which semicolons divide."""
    return [" ".join(x.split()) for x in text.split(";") if x.strip()]
