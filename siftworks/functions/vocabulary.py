"""Word lists of the semantic operators. All are fixed values."""

#: Header spellings of each semantic field, in order of registration.
ALIASES = {
    "name": ["name", "full name", "customer name", "customer", "client", "client name", "lead", "lead name", "prospect", "prospect name", "buyer", "buyer name", "contact name", "contact person", "applicant name", "person name"],
    "email": ["email", "email address", "e-mail", "mail", "mail id", "email id", "primary email", "contact email", "work email"],
    "phone": ["phone", "phone number", "mobile", "mobile number", "cell", "cell number", "contact number", "contact no", "phone no", "whatsapp number", "telephone"],
    "company": ["company", "company name", "organization", "organisation", "employer", "business name", "firm", "firm name"],
    "city": ["city", "town", "location city"],
    "state": ["state", "province", "region"],
    "country": ["country", "nation"],
    "lead_owner": ["lead owner", "owner", "assigned to", "sales owner", "sales rep", "account owner", "agent", "assignee"],
    "crm_status": ["status", "lead status", "crm status", "stage", "deal stage", "pipeline stage"],
    "crm_note": ["notes", "note", "remarks", "comments", "additional notes"],
    "data_source": ["source", "lead source", "data source", "campaign", "campaign name", "referral source", "channel"],
    "possession_time": ["possession", "possession time", "possession date", "handover date"],
    "description": ["description", "details", "inquiry details", "message", "requirement"],
    "created_at": ["created at", "created on", "date created", "submission time", "submitted at", "lead date", "entry date", "timestamp"],
}

#: Header words that tell a kind of dataset; kinds in order of preference.
DATASET_KINDS = {
    "facebook_leads": ["ad_name", "ad_set", "adset", "campaign_name", "form_name", "platform", "lead_id", "full_name", "facebook"],
    "google_ads": ["campaign", "ad_group", "keyword", "gclid", "google_click_id", "submission_time"],
    "real_estate": ["possession", "tower", "project", "flat", "builder", "unit", "bhk", "plot", "site_visit"],
    "marketing": ["utm_source", "utm_campaign", "utm_medium", "channel", "landing_page", "source_campaign"],
    "sales": ["deal", "pipeline", "stage", "quota", "opportunity", "revenue", "deal_stage"],
    "crm_export": ["lead_owner", "crm_status", "lead_status", "last_activity", "account", "owner"],
}

COMPANY_SUFFIXES = ["inc", "llc", "ltd", "limited", "pvt", "corp", "corporation", "co", "llp", "group", "enterprises", "industries", "solutions", "technologies", "traders", "associates", "ventures"]

COUNTRIES = ["india", "united states", "usa", "united kingdom", "uk", "canada", "australia", "singapore", "uae", "united arab emirates", "germany", "france", "china", "japan", "brazil"]
STATES = ["maharashtra", "karnataka", "tamil nadu", "kerala", "telangana", "andhra pradesh", "gujarat", "rajasthan", "uttar pradesh", "west bengal", "punjab", "haryana", "bihar", "madhya pradesh", "delhi", "goa"]
CITIES = ["bengaluru", "bangalore", "mumbai", "delhi", "chennai", "hyderabad", "pune", "kolkata", "ahmedabad", "jaipur", "surat", "lucknow", "new york", "london", "dubai", "san francisco", "singapore"]

NOT_NAMES = [
    "request", "download", "visit", "brochure", "callback", "form", "interest", "inquiry", "enquiry", "info", "information", "details", "detail", "report", "summary", "update", "confirmation", "submission",
    "response", "feedback", "application", "registration", "subscription", "newsletter", "campaign", "promotion", "offer", "discount", "deal", "invoice", "receipt", "order", "payment", "booking", "appointment",
    "meeting", "demo", "webinar", "event", "session", "product", "service", "package", "template", "document", "attachment", "website", "page", "site", "source", "status", "note", "notes", "description",
]

STATUS_WORDS = [
    "new", "open", "closed", "won", "lost", "contacted", "qualified", "follow up", "followup", "interested", "not interested", "converted", "junk", "hot", "warm", "cold", "in progress", "pending", "active",
    "inactive", "sale done", "did not connect", "bad lead", "good lead",
]

#: Header patterns of the deterministic extractor, in order.
HEADER_HINTS = [("name", "name"), ("compan", "company"), ("city", "city"), (r"\bstate\b", "state"), ("countr", "country"), ("status", "crm_status"), ("note|remark", "crm_note"), ("owner", "lead_owner"), ("possession", "possession_time"), ("descri", "description")]

#: Fields that tend to hold many, or few, different values.
VARIED = ["name", "email", "phone", "description", "crm_note", "created_at"]
REPEATED = ["lead_owner", "crm_status", "data_source", "country", "state", "possession_time"]
