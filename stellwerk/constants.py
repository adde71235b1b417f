"""Closed vocabularies and fixed values of the job-market domain."""

from __future__ import annotations

# Employment types, and the flag column of each, in the order in which they are shown.
TYPE_FLAGS = {"minijob": "is_minijob", "werkstudent": "is_werkstudent", "parttime": "is_parttime", "fulltime": "is_fulltime", "internship": "is_internship"}
TYPE_LABELS = {"is_minijob": "minijob", "is_werkstudent": "werkstudent", "is_parttime": "part-time", "is_fulltime": "full-time", "is_internship": "internship"}
# Language levels by rank; answers may also be "unclear".
LEVELS = ["none", "A1", "A2", "B1", "B2", "C1", "C2"]
# Marks of a job, outcomes of a contact, and sources with their kind.
STATUSES = ["new", "interested", "applied", "rejected", "deleted"]
OUTCOMES = ["called", "emailed", "visited", "no"]
SOURCES = {"BA": "api", "AN": "api", "AZ": "api", "KA": "scraper", "XI": "scraper", "SS": "scraper", "ID": "scraper"}
OFF_BY_DEFAULT = ["SS", "ID"]
# Choices of a list, sizes of pages, and limits in days, hours, minutes and times.
POSTED_WITHIN = [3, 7, 30]
SORTS = ["fit", "date", "distance"]
PAGE_SIZE, CONTACTS_PAGE_SIZE, STALE_DAYS = 50, 20, 14
FAILURES_BEFORE_COOLDOWN, COOLDOWN_HOURS, STALE_RUN_MINUTES, MAX_LEGS = 3, 24, 10, 6
# Towns with coordinates; the first is home.
CITIES = {
    "Neuburg an der Donau": (48.7370, 11.1807),
    "Ingolstadt": (48.7665, 11.4258),
    "München": (48.1351, 11.5820),
    "Erlangen": (49.5964, 11.0044),
    "Nürnberg": (49.4520, 11.0768),
    "Würzburg": (49.7913, 9.9534),
    "Ansbach": (49.3005, 10.5722),
    "Regensburg": (49.0134, 12.1016),
    "Augsburg": (48.3712, 10.8982),
    "Landshut": (48.5366, 12.1512),
    "Bamberg": (49.8981, 10.9030),
    "Bayreuth": (49.9456, 11.5713),
    "Passau": (48.5667, 13.4319),
}
HOME = CITIES["Neuburg an der Donau"]
# Radius of a search, and of the earth.
RADIUS_KM, EARTH_KM = 25, 6371.0
# Words by which an ad tells its employment type; the amounts are the monthly ceilings of minijobs.
CEILINGS = ["450", "520", "538", "556", "603"]
TYPE_WORDS = {
    "minijob": ["minijob", "mini-job", "mini job", "nebenjob", "neben-job", "nebentätigkeit", "nebentaetigkeit", "schülerjob", "schuelerjob", "studentenjob", "geringfügig", "geringfuegig", "aushilfe", "aushilfs"]
    + [f"{a}{unit}" for a in CEILINGS for unit in (" €", "€", " euro", "-basis")],
    "werkstudent": ["werkstudent", "studentische hilfskraft", "working student"],
    "internship": ["praktikum", "praktikant", "internship", "trainee"],
    "parttime": ["teilzeit", "part-time", "part time"],
    "fulltime": ["vollzeit", "full-time", "full time"],
}
# What is searched for per employment type.
SEARCH_TERMS = {"minijob": "minijob", "werkstudent": "werkstudent", "parttime": "teilzeit", "fulltime": "vollzeit", "internship": "praktikum"}
# Words of a page that asks for an account.
LOGIN_WORDS = ["bitte melde dich an", "bitte logge dich ein", "zum fortfahren anmelden", "log in to continue", "login to view", "please log in", "sign in to continue"]
# Addresses that are not a business's own, and endings that are files.
FOREIGN_MAIL = ["webdesign", "webagentur", "agentur", "hosting", "noreply", "no-reply"]
FILE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js"]
# Where a site has its imprint, in the order of trying.
IMPRINT_PATHS = ["/impressum", "/kontakt", "/impressum.html", "/contact"]
# German function words; three different ones tell German text.
GERMAN_WORDS = "und oder der die das den dem ein eine einen für mit nicht sind wir sie ist sich bei auf von zu im am als auch werden haben wird".split()
GERMAN_WORDS_NEEDED = 3
# How well kinds of places suit work away from customers, and languages of cuisines.
KIND_SCORES = {"bakery": 85, "hotel": 80, "butcher": 70, "restaurant": 65, "supermarket": 60, "cafe": 45, "fast_food": 40, "bar": 20, "pub": 20}
UNKNOWN_KIND_SCORE, EMAIL_BONUS, LANGUAGE_BONUS, MAX_SCORE = 15, 8, 6, 100
CUISINE_LANGUAGES = {"persian": "persian", "iranian": "persian", "afghan": "persian", "german": "german", "bavarian": "german", "american": "english", "english": "english", "british": "english", "irish": "english"}
# Columns of the exported files.
JOBS_CSV = "job_id source source_id dedupe_key title company city plz lat lon employment_type_raw is_minijob is_parttime is_fulltime is_internship is_werkstudent homeoffice published_at apply_url source_url also_seen_on has_description content_hash first_seen_at last_seen_at status".split()
ENRICHED_CSV = "job_id enriched_at prompt_version provider_used category seniority skills_required skills_nice german_level german_evidence english_sufficient employment_type_norm hours_per_week duties_en requirements_en summary_en fit_score fit_reasons missing_for_fit red_flags application_method contact_email contact_phone deadline".split()
CONTACTS_CSV = "contact_id name kind city street phone email website back_of_house_score osm_id first_seen_at last_contacted_at outcome notes".split()
ANSWER_LISTS = ["skills_required", "skills_nice", "duties_en", "requirements_en", "fit_reasons", "missing_for_fit", "red_flags"]
ENGLISH_FIELDS = ["summary_en", "duties_en", "requirements_en", "fit_reasons"]
