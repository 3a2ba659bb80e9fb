"""Word lists and tables that results depend on."""

# Fixed values, which must equal those of the service whose results are matched.
STOPWORDS = (
    "what", "is", "the", "are", "on", "for", "in", "of", "to", "a", "an", "and", "by", "according", "about", "how", "does", "regulate", "when", "should", "be", "held", "rules", "rule",
    "clause", "guidelines", "guideline", "manual", "policy", "say", "transparency", "having", "with", "from", "that", "this", "these", "those", "under", "rules/sections", "related",
    "document", "documents", "reference",
)
TERM_STOPWORDS = (
    "what", "is", "the", "are", "on", "for", "in", "of", "to", "a", "an", "and", "by", "how", "kya", "hai", "ko", "ke", "liye", "kese", "kaise", "kab", "kon", "nhi", "nahi", "क्या", "है",
    "को", "के", "लिए", "कैसे", "कब", "कौन", "नहीं", "का", "की", "में", "पर",
)
SPELLINGS = (
    ("submissiom", "submission"), ("submisson", "submission"), ("submitt", "submit"), ("tendor", "tender"), ("tenders", "tender"), ("emc", "emd"),
    ("bidding", "bid submission"), ("courruption", "corruption"), ("coruption", "corruption"), ("corrupcion", "corruption"),
)
TOPICS = {
    "emd": ["emd", "earnest money", "bid security", "security deposit", "bidsecurity"],
    "gfr": ["gfr", "general financial rules", "general financial rule", "rule", "rules", "clause", "chapter"],
    "gem": ["gem", "government e-marketplace", "gem portal", "marketplace", "buyer", "reverse auction"],
    "cvc": ["cvc", "vigilance", "anti corruption", "compliance", "vigilance manual"],
    "registration": ["register", "registration", "vendor registration", "supplier registration", "sign up", "sign-up"],
    "dsc": ["dsc", "digital signature", "class ii", "class iii", "certificate"],
    "bid_submission": ["bid submission", "submission", "submit bid", "submiss", "submissiom", "submitt", "quotation", "tender submission", "bid preparation", "price bid"],
    "short_tender": ["short tender", "short term tender", "notice period", "limited tender"],
    "service_procurement": ["service procurement", "consulting services", "outsourcing", "service", "procurement of services"],
    "msme": ["msme", "mse", "micro and small", "price preference", "l1+15", "l-1"],
    "faq": ["faq", "frequently asked questions", "questions"],
    "store_purchase_rules": [
        "store purchase", "store purchase rule", "cg store", "bhandar kray", "bhandar", "cg rules", "cg rule", "chhattisgarh", "छत्तीसगढ़", "भंडार क्रय",
        "projector", "laptop", "ac", "air conditioner", "goods", "items", "furniture", "computer", "printer", "vehicle", "equipment",
        "procurement", "purchase", "tender", "limit", "threshold", "committee", "limited tender", "open tender", "single tender", "direct purchase",
        "emd", "earnest money", "emand", "bid security", "local purchase", "lpc", "lpc committee", "rate contract",
        "repeat order", "inspection", "payment", "penalty", "preference", "msme", "startup", "sc st", "obc", "handicraft", "handloom",
        "क्रय", "खरीद", "निविदा", "सीमा", "समिति", "भुगतान", "जुर्माना",
    ],
}
RULE_TERMS = {
    "163": ["two-bid", "two bid", "double bid", "दो-बोली", "दो बोली", "द्वि-बोली", "द्वि बोली", "दो-बिड", "दो बिड", "दो-बोली प्रणाली"],
    "164": ["two-stage bidding", "two stage bidding", "दो-चरण बोली", "दो चरण बोली", "दो-चरण"],
    "165": ["late bid", "late bids", "देर से प्राप्त बोली", "देर से प्राप्त बोलियां", "देर से बोली", "विलंब", "देर से"],
    "170": ["emd", "bid security", "earnest money", "बयाना राशि", "बोली सुरक्षा", "बयाना"],
    "171": ["performance security", "performance guarantee", "performance bank guarantee", "प्रदर्शन प्रतिभूति", "प्रदर्शन सुरक्षा", "निष्पादन प्रतिभूति", "परफॉर्मेंस"],
    "162": ["limited tender", "सीमित निविदा"],
    "166": ["single tender", "proprietary article", "एकल निविदा", "स्वामित्व प्रमाण पत्र"],
    "161": ["advertised tender", "open tender", "विज्ञापन के माध्यम से निविदा", "खुली निविदा"],
    "155": ["local purchase committee", "स्थानीय क्रय समिति", "स्थानीय खरीद समिति"],
    "154": ["purchase without quotation", "बिना कोटेशन के खरीद"],
}
TOPIC_WEIGHTS = {
    "emd": 25, "gfr": 20, "gem": 15, "cvc": 15, "registration": 12, "dsc": 10, "bid_submission": 18, "short_tender": 10, "service_procurement": 12, "msme": 15, "faq": 8, "store_purchase_rules": 50,
}
VAGUE = (
    "yeh", "iska", "uska", "aage", "next", "phir", "baad", "step", "kya karu", "kya karna", "nahi", "nhi", "problem", "issue", "samajh", "bata", "detail", "explain", "aur", "woh", "waha",
    "this", "that", "it", "then", "after", "before", "above", "below",
)
HINGLISH = (
    "kya", "ko", "hain", "ke", "liye", "hona", "chahiye", "fayde", "fayda", "milega", "milte", "kab", "kaise", "kon", "kis", "nhi", "nahi", "sakte",
)
SENTENCE_ENDS = (". ", "। ", ".\n", "।\n", "\n")
ROLES = (("vendor", "vendor"), ("govt", "government_officer"))
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 150
CONTEXT_CHARS, CHUNK_CHARS, LEAST_REST = 4000, 2500, 500
FUZZY = 0.65
