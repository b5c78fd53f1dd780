"""Vocabularies and value maps used by the rules.

FIXED VALUES: the lists and maps below must equal the source behaviour for
the results to match, so they are stated plainly, in their natural order.
Two quirks are corrected as documented in the README (keyword case for the
work-type map, the month map without the misspelt extra key).  Tables larger
than about 200 entries (the profession-title list) are not shipped: they are
a parameter (a DataFrame) of the operator that needs them.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Polish month names in the genitive, mapped to English (expiry parser).
POLISH_MONTHS = {
    "stycznia": "January", "lutego": "February", "marca": "March",
    "kwietnia": "April", "maja": "May", "czerwca": "June", "lipca": "July",
    "sierpnia": "August", "września": "September", "października": "October",
    "listopada": "November", "grudnia": "December",
}

# Contract text as crawled -> standard label (unmapped values are kept).
CONTRACT_VALUES = {
    "contract of employment": "Contract of Employment",
    "umowa o pracę": "Contract of Employment",
    "kontrakt B2B": "B2B Contract",
    "contract of employment (full-time)": "Contract of Employment (Full-Time)",
    "umowa o pracę (pełny etat)": "Contract of Employment (Full-Time)",
    "kontrakt B2B (pełny etat)": "B2B Contract (Full-Time)",
    "umowa o pracę, kontrakt B2B": "Contract of Employment, B2B Contract",
    "contract of employment, B2B contract": "Contract of Employment, B2B Contract",
    "umowa o pracę, kontrakt B2B (pełny etat)": "Contract of Employment, B2B Contract (Full-Time)",
    "umowa o pracę, umowa na zastępstwo": "Contract of Employment, Substitution Agreement",
    "contract of employment, B2B contract (full-time)": "Contract of Employment, B2B Contract (Full-Time)",
    "umowa o pracę, umowa zlecenie, kontrakt B2B": "Contract of Employment, Contract of Mandate, B2B Contract",
    "other": "Other",
    "Other": "Other",
    "B2B contract": "B2B Contract",
    "B2B contract (full-time)": "B2B Contract (Full-Time)",
    "contract of mandate": "Contract of Mandate",
    "substitution agreement": "Substitution Agreement",
    "contract of work": "Contract of Work",
    "agency agreement": "Agency Agreement",
    "temporary staffing agreement": "Temporary Staffing Agreement",
    "contract for specific work": "Contract for Specific Work",
    "internship, apprenticeship contract": "Internship, Apprenticeship Contract",
    "contract of temporary employment": "Contract of Temporary Employment",
    "kontrakt B2B, umowa o pracę": "Contract of Employment, B2B Contract",
    "kontrakt B2B, umowa o pracę to this B2B Contract": "Contract of Employment, B2B Contract",
    "umowa zlecenie": "Contract of Mandate",
    "umowa zlecenie (pełny etat)": "Contract of Mandate (Full-Time)",
    "umowa o dzieło, umowa zlecenie, kontrakt B2B": "Contract of Work, Contract of Mandate, B2B Contract",
    "umowa zlecenie, kontrakt B2B": "Contract of Mandate, B2B Contract",
    "umowa o pracę (część etatu, pełny etat)": "Contract of Employment (Part-Time, Full-Time)",
    "contract of employment (full-time, part time)": "Contract of Employment (Full-Time, Part-Time)",
    "Employment contract": "Contract of Employment",
}

# Contract labels that become 0/1 columns (exact token of ", "-split).
CONTRACT_LABELS = [
    "B2B Contract", "Contract of Employment", "Contract of Mandate",
    "Substitution Agreement", "Contract of Work", "Agency Agreement",
    "Temporary Staffing Agreement", "Contract for Specific Work",
    "Internship / Apprenticeship Contract", "Contract of Temporary Employment",
]
CONTRACT_COLUMNS = [
    "b2b_contract", "employment_contract", "mandate_contract",
    "substitution_agreement", "work_contract", "agency_agreement",
    "temporary_staffing_agreement", "specific_work_contract",
    "internship_apprenticeship_contract", "temporary_employment_contract",
]

# Benefit category -> keywords (case-insensitive substring match).
BENEFIT_CATEGORIES = {
    "work_life_balance": [
        "volunteering", "remote work", "days off", "workday", "day off", "work-life", "home office",
        "work remotely", "Flexible working hours", "Volunteer hours", "possibility of remote work",
        "one shorter workday", "time for development of your ideas", "additional leave",
        "+3 days off for fathers due to the birth of a child", "remote work opportunities",
        "flexible work from home scheme after pandemic/lockdown", "flexible working time",
        "Remote/hybrid work", "Freedom to choose your working model (HO/hybrid/office)", "extra leave",
        "additional days off for parents",
    ],
    "financial_rewards_and_benefits": [
        "salary", "compensation", "bonus", "holiday funds", "cafeteria platform", "bonus system",
        "redeployment package", "social fund", "life insurance", "preferential loans", "Beer allowance",
        "discounts on equipment purchases in our stores", "child’s starter kit", "MultiSport card",
        "summer and winter activities for children", "Christmas bonuses", "Christmas packages",
        "equity", "MBA support", "IP tax benefit", "Financial bonus", "Copyright Tax Deduction",
        "development budget", "Christmas bonus", "Money for moving expenses",
    ],
    "health_and_wellbeing": [
        "medical", "care", "health", "wellbeing", "psychological support", "medical care", "mental health",
        "Healthcare package", "Life insurance", "dental care", "wellbeing program", "massage services at the office",
        "mentoring care", "funding for private medical care Medicover", "Leisure package for families",
        "Healthcare package for families", "gym access", "massage services", "Yoga", "sports teams", "cycling club",
        "wellbeing initiatives", "health screenings", "vaccination programs", "ergonomic office setup",
    ],
    "personal_and_professional_development": [
        "training", "course", "certification", "development", "academy", "learning", "Mentoring and coaching",
        "funding for training and courses", "external training", "foreign language lessons",
        "Employee psychological support program", "soft skills training", "access to +100 projects",
        "employee referral program", "workshops and webinars for employees", "technical support from technology leaders",
        "MBA support", "development budget", "conferences in Poland", "conferences abroad",
        "access to e-learning platforms", "access to Pluralsight",
    ],
    "workplace_environment_and_culture": [
        "office", "workspace", "environment", "modern office", "office equipment", "Non-corporate atmosphere",
        "Chill room", "physiotherapy sessions in the company", "video games at work", "Relaxation room", "Game room",
        "space for experimenting", "electric vehicle charging stations", "modern & ergonomic eco-office",
        "convenient location (WIERZBNO)", "Playground and grill", "in-house gym", "modern ergonomic office",
        "casual dress code", "gaming room", "library", "fruit days", "free snacks", "hot beverages", "fruits",
        "coffee", "tea", "cold beverages", "baby layette", "family-friendly initiatives", "holiday events",
        "birthday celebrations", "Integration events", "Innovation Days", "open bar on Fridays",
    ],
    "mobility_and_transport": [
        "car leasing", "parking", "bike parking", "employee parking", "Help finding an apartment", "prime mobility",
        "Visa Services", "temporary housing", "electric vehicle charging stations", "shower facilities",
        "subsidized commuting costs",
    ],
    "unique_benefits": [
        "Beer allowance", "company supports open source projects", "unlimited free access to Copernicus Science Center",
        "Prime Academy", "Open to Ukrainian candidates", "employee discounts", "deputat beer",
        "saving & investment scheme",
    ],
    "community_and_social_initiatives": [
        "volunteering opportunities", "charity initiatives", "help in finding an apartment", "family picnics",
        "Integration events", "company library", "cultural events", "workshops & webinars for employees",
        "conferences abroad", "conferences in Poland", "company sports teams", "cycling club", "picnics",
        "social impact initiatives", "diversity and inclusion programs",
    ],
}
BENEFIT_COLUMNS = list(BENEFIT_CATEGORIES)

# Language flag column -> keywords (any text column, case-insensitive substring).
LANGUAGE_KEYWORDS = {
    "language_english": ["English", "Angielski", "Angielsku"],
    "language_german": ["German", "Deutsch", "Niemiecki", "Niemiecku"],
    "language_french": ["French", "Français", "Francuski", "Francusku"],
    "language_spanish": ["Spanish", "Español", "Hiszpański", "Hiszpańsku"],
    "language_italian": ["Italian", "Italiano", "Włoski", "Włosku"],
    "language_dutch": ["Dutch", "Nederlands", "Holenderski", "Holendersku"],
    "language_russian": ["Russian", "Русский", "Rosyjski", "Rosyjsku"],
    "language_chinese_mandarin": ["Mandarin", "普通话", "Mandaryński", "Mandaryńsku"],
    "language_japanese": ["Japanese", "日本語", "Japoński", "Japońsku"],
    "language_portuguese": ["Portuguese", "Português", "Portugalski", "Portugalsku"],
    "language_swedish": ["Swedish", "Svenska", "Szwedzki", "Szwedzku"],
    "language_danish": ["Danish", "Dansk", "Duński", "Duńsku"],
}
LANGUAGE_COLUMNS = list(LANGUAGE_KEYWORDS)

# Language name as chosen in a filter -> flag column (Mandarin fixed, Q11).
LANGUAGE_FILTER_COLUMN = {
    "english": "language_english", "german": "language_german", "french": "language_french",
    "spanish": "language_spanish", "italian": "language_italian", "dutch": "language_dutch",
    "russian": "language_russian", "mandarin": "language_chinese_mandarin",
    "japanese": "language_japanese", "portuguese": "language_portuguese",
    "swedish": "language_swedish", "danish": "language_danish",
}

# Experience description -> level.
JOB_LEVELS = {
    "specialist (Mid / Regular)": "middle", "junior specialist (Junior)": "junior",
    "specjalista (Mid / Regular)": "middle", "senior specialist (Senior), expert": "lead",
    "senior specialist (Senior)": "senior", "menedżer": "senior",
    "starszy specjalista (Senior)": "senior", "praktykant / stażysta": "internship", "team manager": "lead",
    "trainee": "internship", "specjalista (Mid / Regular), starszy specjalista (Senior)": "senior",
    "specialist (Mid / Regular), senior specialist (Senior)": "senior",
    "starszy specjalista (Senior), ekspert": "lead", "asystent, młodszy specjalista (Junior)": "junior",
    "asystent": "junior", "{expert}": "lead", "kierownik / koordynator": "lead",
    "specjalista (Mid / Regular), młodszy specjalista (Junior)": "middle",
    "młodszy specjalista (Junior)": "junior", "{mid}": "middle", "{senior}": "senior", "{manager}": "senior",
    "{lead}": "lead", "junior": "junior", "senior ekspert": "lead", "mid / regular": "middle",
    "senior expert": "lead", "senior specialist": "senior", "manager / supervisor": "lead",
    "Mid/Regular": "middle", "Junior": "junior", "Senior": "senior", "Internship": "internship", "Lead": "lead",
    "specjalista (Mid / Regular), junior specialist (Junior)": "middle",
    "specjalista": "middle", "dyrektor": "lead",
    "senior manager": "lead", "head manager": "lead", "starszy specjalista (Lead)": "lead",
    "specialist (Mid / Regular), junior specialist (Junior)": "middle", '{"senior • expert"}': "senior",
    '{"junior • mid"}': "middle", '{"mid • senior"}': "senior", "{junior}": "junior", '{"lead • manager"}': "lead",
}
LEVEL_COLUMNS = ["internship", "junior", "middle", "senior", "lead"]

# Filter label -> level flag column.
LEVEL_FILTER_COLUMN = {"Intern": "internship", "Junior": "junior", "Middle": "middle",
                       "Senior": "senior", "Lead": "lead"}

# Work-type flag -> keywords, compared with lower-cased text (keywords
# lower-cased here: Q6).
WORK_TYPE_KEYWORDS = {
    "full_time": ["full office work", "full time", "praca stacjonarna", "home office work"],
    "hybrid": ["remote work", "praca hybrydowa", "hybrid work", "praca hybrydowa"],
    "remote": ["praca zdalna", "remote", "hybrid work", "praca mobilna"],
}
WORK_TYPE_COLUMNS = list(WORK_TYPE_KEYWORDS)
WORK_TYPE_FILTER_COLUMN = {"Full-time": "full_time", "Hybrid": "hybrid", "Remote": "remote"}

# Level words removed from titles before role matching.
LEVEL_TERMS = ["junior", "middle", "mid", "senior", "lead", "team leader", "team lead", "tl",
               "intern", "internship", "entry-level", "entry level", "experienced"]

# Word-wise Polish -> English translation (keys lower-cased: Q19).
TRANSLATION = {
    "analityk": "Analyst", "młodszy": "Junior", "programistka": "", "programista": "Developer",
    "sieci": "Network", "inżynier": "Engineer", "automatyki": "Automation", "specjalista": "Specialist",
    "konsultant": "Consultant", "konsultantka": "Consultant", "systemu": "System", "architekt": "Architect",
    "manualny": "Manual", "informatyki": "IT", "analityczka": "Analyst", "technik serwisu": "Service Technician",
    "monitoringu": "Monitoring", "kampanii": "Campaign", "infrastruktury": "Infrastructure",
    "informatyk": "IT Specialist",
}

# Technology names never added by the vocabulary match.
TECH_STOP = {
    "LESS", "PROJECT", "DESIGN", "WINDOWS", "SUPPORT", "DATA", "DATABASE", "TEAMS",
    "DATABASES", "MICROSOFT", "NIST", "MEET", "BPMN", "APPLICATIONS", "MAST", "ENGLISH",
    "BUSINESS ANALYSIS", "DEVELOPMENT", "MANAGEMENT", "ANALYSIS", "PROJECT MANAGEMENT", "PROJECTS",
    "VMWA", "SNOW", "CODE",
}

# Technology names of two characters or fewer that are still kept (longer
# names are always eligible).
TECH_KEEP_SHORT = {
    "C#", "S3", "VR", "BI", "CI", "CD", "AI", "ML", "QA", "OS", "UX", "ID", "DB", "IO", "IP",
    "IR", "HD", "AD", "DC",
}

# Curated table column order (the output contract).
JOBS_COLUMNS = [
    "id", "job_title", "core_role", "employer_name", "city", "lat", "long",
    "region", "start_salary", "max_salary", "technologies_used",
    "worker_responsibilities", "job_requirements", "offering", "benefits",
    "work_life_balance", "financial_rewards_and_benefits",
    "health_and_wellbeing", "personal_and_professional_development",
    "workplace_environment_and_culture", "mobility_and_transport",
    "unique_benefits", "community_and_social_initiatives", "b2b_contract",
    "employment_contract", "mandate_contract", "substitution_agreement",
    "work_contract", "agency_agreement", "temporary_staffing_agreement",
    "specific_work_contract", "internship_apprenticeship_contract",
    "temporary_employment_contract", "language_english", "language_german",
    "language_french", "language_spanish", "language_italian",
    "language_dutch", "language_russian", "language_chinese_mandarin",
    "language_japanese", "language_portuguese", "language_swedish",
    "language_danish", "internship", "junior", "middle", "senior", "lead",
    "full_time", "hybrid", "remote", "upload_id", "expiration", "url",
    "date_posted",
]

# Report names of the same 57 columns, positionally.
REPORT_COLUMNS = [
    "ID", "JobTitle", "CoreRole", "Employer", "City", "Latitude", "Longitude",
    "Region", "StartSalary", "MaxSalary", "Technologies", "Responsibilities",
    "Requirements", "Offering", "Benefits", "WorkLifeBalance",
    "FinancialRewards", "HealthWellbeing", "Development",
    "WorkplaceCulture", "MobilityTransport", "UniqueBenefits",
    "SocialInitiatives", "B2BContract", "EmploymentContract",
    "MandateContract", "SubstitutionAgreement", "WorkContract",
    "AgencyAgreement", "TempStaffingAgreement", "SpecificWorkContract",
    "InternshipContract", "TempEmploymentContract", "English",
    "German", "French", "Spanish", "Italian",
    "Dutch", "Russian", "Mandarin", "Japanese",
    "Portuguese", "Swedish", "Danish", "Internship",
    "Junior", "Middle", "Senior", "Lead", "FullTime", "Hybrid",
    "Remote", "UploadID", "Expiration", "URL", "DatePosted",
]

# Raw-to-curated renames (absent names are ignored).
RAW_RENAMES = {
    "technologies": "technologies_used", "responsibilities": "worker_responsibilities",
    "requirements": "job_requirements", **dict(zip(CONTRACT_LABELS, CONTRACT_COLUMNS)),
}

# Export drops these internal columns.
EXPORT_DROP = ["id", "core_role", "lat", "long", "upload_id"]

# Review rating labels -> 1..5.
RATING_LABELS = {"Very bad": 1, "Bad": 2, "Okay": 3, "Good": 4, "Excellent": 5}

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# ------------------------------------------------------------ END FIXED VALUES
