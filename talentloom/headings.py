"""Section headings of CVs and job offers, by section type.

Fixed values: results depend on every entry. Headings are written as lines are
compared: lower-case, without accents, marks as blanks. Callers may pass a table of
their own wherever a ``headings`` parameter stands.
"""

from __future__ import annotations

#: English headings by section type.
ENGLISH = {
    "PERSONAL_INFORMATION": (
        "personal info", "personal information", "contact information", "contact info", "contact details", "contact", "contacts", "contact personal info",
        "personal details", "personal profile", "identity", "address and contact", "contact address",
    ),
    "SUMMARY": (
        "summary", "professional summary", "professional profile", "executive profile", "profile", "professional overview", "career overview", "career focus",
        "executive summary", "qualification summary", "background summary", "personal summary", "brief summary", "objective", "career objective",
        "objective statement", "professional objective", "job objective", "employment objective", "personal objective", "about", "about me", "synopsis",
        "introduction", "headline", "biography", "bio", "short bio",
    ),
    "HIGHLIGHTS": ("highlights", "career highlights", "key highlights"),
    "CORE_QUALIFICATIONS": ("core qualifications", "qualifications summary", "summary of qualifications"),
    "EXPERIENCE": (
        "experience", "experiences", "work experience", "work experiences", "professional experience", "professional experiences", "employment history",
        "employment", "work history", "career history", "career summary", "professional background", "background", "relevant experience",
        "relevant work experience", "related experience", "applicable experience", "key experience", "selected experience", "selected professional experience",
        "industry experience", "corporate experience", "technical experience", "engineering experience", "project experience", "freelance experience",
        "freelance", "contract work", "consulting experience", "internship", "internships", "internship experience", "placement history", "placement",
        "placements", "academic experience", "research experience", "teaching experience", "graduate experience", "military experience", "military history",
        "history", "record", "employment record", "professional record", "work record",
    ),
    "EDUCATION": (
        "education", "educational", "education background", "educational background", "education history", "educational history",
        "educational qualifications", "education qualifications", "education and qualifications", "academic background", "academic history",
        "academic record", "academic credentials", "academic qualifications", "academics", "formal education", "training", "education training",
        "education and training", "training education", "training courses", "professional training", "vocational training", "continuing education",
        "further education", "coursework", "relevant coursework", "courses", "degrees", "degrees and certificates", "degrees and certifications", "diplomas",
        "studies", "university education", "college education",
    ),
    "PROJECTS": (
        "projects", "key projects", "major projects", "selected projects", "notable projects", "featured projects", "professional projects",
        "technical projects", "engineering projects", "personal projects", "side projects", "independent projects", "academic projects", "school projects",
        "university projects", "college projects", "research projects", "capstone projects", "thesis", "portfolio", "project portfolio", "open source",
        "open source contributions", "development projects",
    ),
    "SKILLS": (
        "skills", "key skills", "core skills", "professional skills", "essential skills", "relevant skills", "selected skills", "summary of skills",
        "skills summary", "competencies", "core competencies", "key competencies", "professional competencies", "skills and competencies", "expertise",
        "skills expertise", "areas of expertise", "core expertise", "area of expertise", "professional expertise", "proficiencies",
        "technical proficiencies", "technical proficiency", "capabilities", "core capabilities", "it skills", "computer skills", "software skills",
        "digital skills", "hard skills", "soft skills", "languages and skills", "technology stack", "tools", "tools and technologies",
    ),
    "TECHNICAL_SKILLS": ("technical skills", "technical expertise"),
    "CERTIFICATIONS": (
        "certifications", "certification", "certificates", "certificate", "licenses", "licences", "licensure", "credentials", "professional credentials",
        "professional certifications", "professional certificates", "professional licenses", "licenses and certifications", "licences and certifications",
        "certifications and licenses", "certifications and credentials", "accreditations", "professional accreditations",
    ),
    "LANGUAGES": (
        "languages", "language", "language skills", "language proficiencies", "language proficiency", "linguistic skills", "linguistic capabilities",
        "spoken languages", "foreign languages",
    ),
    "ACHIEVEMENTS": (
        "achievements", "professional achievements", "key achievements", "career achievements", "awards", "key awards", "honors", "honours",
        "awards and honors", "awards and honours", "honors and awards", "honours and awards", "distinctions", "accomplishments", "key accomplishments",
        "recognition", "professional recognition",
    ),
    "PUBLICATIONS": (
        "publications", "published work", "published works", "selected publications", "articles", "papers", "academic publications",
        "research publications", "books and articles",
    ),
    "PRESENTATIONS": (
        "presentations", "selected presentations", "keynote presentations", "speaking engagements", "speaking", "conferences", "conference presentations",
        "talks", "public speaking", "workshops",
    ),
    "VOLUNTEER_EXPERIENCE": (
        "volunteer experience", "volunteer experiences", "volunteering", "volunteer work", "volunteer history", "community service",
        "community involvement", "community experience", "social work", "pro bono work", "pro bono", "philanthropy",
    ),
    "LEADERSHIP": ("leadership", "leadership experience", "leadership activities", "leadership roles", "management experience", "extracurricular leadership"),
    "INTERESTS": ("interests", "personal interests", "areas of interest", "leisure activities", "activities"),
    "HOBBIES": ("hobbies", "hobbies and interests", "interests and hobbies", "personal hobbies", "pastimes"),
    "AFFILIATIONS": (
        "affiliations", "professional affiliations", "memberships", "professional memberships", "professional bodies", "associations",
        "professional associations", "societies", "professional societies",
    ),
    "SCHOLARSHIPS": (
        "scholarships", "scholarships and awards", "grants", "grants and scholarships", "fellowships", "academic scholarships", "bursaries",
    ),
    "ADDITIONAL_INFORMATION": (
        "additional information", "additional info", "other information", "other info", "miscellaneous", "misc", "further information", "further info",
        "additional details",
    ),
    "RESPONSIBILITIES": ("responsibilities", "what you'll do", "the role", "role", "key responsibilities"),
    "REQUIREMENTS": ("requirements", "qualifications", "what we're looking for", "required skills", "must have"),
}

#: French headings by section type.
FRENCH = {
    "PERSONAL_INFORMATION": (
        "informations personnelles", "information personnelle", "informations de contact", "information de contact", "coordonnees", "contact", "contacts",
        "me contacter", "etat civil", "informations generales", "renseignements personnels", "details personnels", "a propos de moi",
    ),
    "SUMMARY": (
        "profil", "profil professionnel", "resume", "resume professionnel", "presentation", "introduction", "vue d'ensemble", "synthese",
        "synthese professionnelle", "sommaire des qualifications", "sommaire professionnel", "a propos", "objectif", "objectifs", "objectif professionnel",
        "objectifs professionnels", "projet professionnel", "aspiration", "aspirations", "qui suis je", "ma biographie", "bio", "accroche",
    ),
    "EXPERIENCE": (
        "experience", "experiences", "experience professionnelle", "experiences professionnelles", "experience de travail", "experiences de travail",
        "parcours professionnel", "parcours professionnels", "historique professionnel", "antecedents professionnels", "carriere", "historique d'emploi",
        "historique d'emplois", "experience d'emploi", "background professionnel", "experience professionnelle et stages",
        "experiences professionnelles et stages", "stage", "stages", "experience de stage", "experiences de stage",
    ),
    "EDUCATION": (
        "formation", "formations", "formation academique", "formations academiques", "parcours academique", "parcours scolaire", "etudes",
        "etudes superieures", "scolarite", "diplome", "diplomes", "diplomes et formations", "titres et diplomes", "cursus", "cursus academique",
        "education", "background academique", "enseignements",
    ),
    "PROJECTS": (
        "projet", "projets", "projets personnels", "projet personnel", "projets academiques", "projet academique", "projets notables", "projets cles",
        "realisations techniques", "projets professionnels", "portfolio", "travaux",
    ),
    "SKILLS": (
        "competence", "competences", "competences professionnelles", "competences cles", "competences de base", "domaines de competence",
        "domaines de competences", "resume des competences", "savoir faire", "aptitudes", "atouts",
    ),
    "TECHNICAL_SKILLS": (
        "competences techniques", "competence technique", "expertise technique", "expertises techniques", "competences informatiques",
        "competences logicielles", "competences digitales", "maitrise technique", "technologies", "outils", "outils et technologies",
        "environnement technique", "environnements techniques", "competences it",
    ),
    "CERTIFICATIONS": (
        "certificat", "certificats", "certification", "certifications", "accreditation", "accreditations", "licence", "licences", "permis",
        "certifications professionnelles", "certificats professionnels", "habilitations", "attestations",
    ),
    "LANGUAGES": ("langue", "langues", "langues vivantes", "competences linguistiques", "langues maitrisees", "connaissances linguistiques"),
    "ACHIEVEMENTS": (
        "realisation", "realisations", "distinction", "distinctions", "prix", "recompense", "recompenses", "honneurs", "succes", "accomplissements",
        "palmares",
    ),
    "VOLUNTEER_EXPERIENCE": (
        "benevolat", "benevole", "experience de benevolat", "experiences de benevolat", "experience associative", "experiences associatives",
        "volontariat", "engagement associatif", "engagement citoyen", "activites associatives", "travail communautaire",
    ),
    "INTERESTS": ("centres d'interet", "centre d'interet", "interets", "centres d'interets", "activites annexes"),
    "HOBBIES": ("loisir", "loisirs", "passions", "passion", "hobbies", "hobby", "loisirs et interets"),
    "AFFILIATIONS": (
        "association", "associations", "affiliation", "affiliations", "affiliations professionnelles", "membre", "organisations",
        "societes professionnelles", "adhesions",
    ),
    "ADDITIONAL_INFORMATION": (
        "informations complementaires", "information complementaire", "informations additionnelles", "information additionnelle", "divers",
        "autres informations", "autre information", "renseignements complementaires", "details complementaires", "plus d'informations", "plus d'infos",
    ),
}

#: Default headings by section type.
HEADINGS = {kind: tuple(dict.fromkeys([*english, *FRENCH.get(kind, ())])) for kind, english in ENGLISH.items()}
