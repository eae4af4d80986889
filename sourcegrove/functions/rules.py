"""Fixed values of the question rules: these must be as they are for right results. Order is meaning: the first match wins."""

# Fixed values: (patterns, expansions) of high-precision relations.
HIGH_PRECISION = [
    ([r"\bwebsocket\b.*\b(?:rfc|standart|standard|doküman|dokuman|şartname)\w*", r"\bwebsocket\b.*\btanımlan\w*", r"\bhangi(?:\s+\w+){0,3}\s+(?:rfc|doküman)\w*.*\bwebsocket\b"],
     ["The WebSocket Protocol", "WebSocket RFC specification", "WebSocket protocol overview"]),
    ([r"\bpdu\s+session\b.*\bbaşlat\w*.*\bmesaj", r"\bpdu\s+session\b.*\bestablish\w*.*\bmesaj", r"\bpdu\s+session\b.*\bhangi\s+nas\s+mesaj"],
     ["PDU SESSION ESTABLISHMENT REQUEST", "UE-requested PDU session establishment procedure", "PDU session establishment NAS message"]),
    ([r"\bamf\b.*\bsmf\b.*\breferans\s+nokt", r"\bsmf\b.*\bamf\b.*\breferans\s+nokt", r"\bamf\b.*\bsmf\b.*\breference\s+point", r"\bsmf\b.*\bamf\b.*\breference\s+point"],
     ["AMF SMF reference point", "reference point between AMF and SMF", "5GS reference point representation AMF SMF"]),
    ([r"\bng[-\s]?ran\b.*\bamf\b.*\bprotokol", r"\bamf\b.*\bng[-\s]?ran\b.*\bprotokol", r"\bng[-\s]?ran\b.*\bamf\b.*\bprotocol", r"\bamf\b.*\bng[-\s]?ran\b.*\bprotocol"],
     ["NG-RAN AMF protocol", "NG interface application protocol", "protocol between NG-RAN and AMF"]),
    ([r"\bregistration\s+management\b.*\bnetwork\s+function", r"\bnetwork\s+function\b.*\bregistration\s+management", r"\b5gs\b.*\bregistration\s+management\b.*\bfunction"],
     ["5GS Registration Management responsible network function", "network function responsible for Registration Management", "Registration Management functionality in 5GS"]),
    ([r"\be\.?164\b.*\bkaç\s+basamak", r"\be\.?164\b.*\bmaksimum", r"\be\.?164\b.*\bmaximum", r"\be\.?164\b.*\blength", r"\be\.?164\b.*\bdigit"],
     ["E.164 number maximum length", "maximum length of E.164 number", "E.164 numbering plan number length"]),
    ([r"\bquic\b.*\bkayıp\b", r"\bquic\b.*\bloss\b", r"\bquic\b.*\bcongestion\b", r"\bquic\b.*\brecovery\b"],
     ["QUIC loss detection and congestion control", "loss detection and congestion control for QUIC", "QUIC loss detection and recovery"]),
    ([r"\bngap\b.*\b(?:standart|standard|specification)\w*", r"\bngap\b.*\btanımlan\w*"],
     ["NG Application Protocol NGAP specification", "NGAP protocol is defined in 3GPP TS", "NG-RAN NG interface NG application protocol"]),
    ([r"\b5g(?:s|\s+system)?\b.*\barchitecture\b.*\b(?:standart|standard|şartname|sartname|doküman)\w*", r"\b5g(?:s|\s+system)?\b.*\bmimari\w*.*\b(?:standart|standard|şartname|sartname|doküman)\w*"],
     ["System Architecture for the 5G System Stage 2", "Stage 2 system architecture for the 5G System", "present document defines the Stage 2 system architecture for the 5G System"]),
    ([r"\b5g(?:s|\s+system)?\b.*\bprosedür\w*.*\b(?:standart|standard)\w*", r"\b5g(?:s|\s+system)?\b.*\bprocedures?\b.*\b(?:standart|standard)\w*"],
     ["Procedures for the 5G System Stage 2", "5G System stage 2 procedures and flows", "Procedures for the 5G System"]),
    ([r"\bquic\b.*\btls\b", r"\btls\b.*\bquic\b"],
     ["Using TLS to Secure QUIC", "QUIC TLS security", "QUIC TLS handshake"]),
    ([r"\bquic\b.*\bversion-independent\b", r"\bquic\b.*\binvariants?\b"],
     ["Version-Independent Properties of QUIC", "QUIC-INVARIANTS", "version-independent properties of QUIC"]),
    ([r"\bqpack\b"],
     ["QPACK Field Compression for HTTP/3", "QPACK", "QPACK field compression"]),
    ([r"\bwebsockets?\b.*\bhttp/?3\b", r"\bhttp/?3\b.*\bwebsockets?\b"],
     ["Bootstrapping WebSockets with HTTP/3", "WebSockets Upgrade over HTTP/3", "WebSockets HTTP/3"]),
    ([r"\bquic\b.*\brfc", r"\bquic\b.*\bhangi\s+standart", r"\bquic\b.*\bhangi\s+rfc", r"\bquic\b.*\bdefined\b", r"\bquic\b.*\btanımlan"],
     ["QUIC version 1 core protocol", "core QUIC transport protocol specification", "document defines version 1 of QUIC"]),
    ([r"\bhttp/?3\b.*\brfc\b", r"\bhttp/?3\b.*\btanımlan\w*", r"\bhttp/?3\b.*\bhangi(?:\s+\w+){0,2}\s+(?:rfc|standart|doküman)"],
     ["This document defines HTTP/3", "HTTP/3 RFC specification", "HTTP/3 Protocol Overview"]),
    ([r"\bhttp/?3\b.*\btaşıma\s+protokol", r"\bhttp/?3\b.*\btransport\s+protocol", r"\bhttp/?3\b.*\bhangi(?:\s+\w+){0,3}\s+protokol"],
     ["HTTP/3 underlying transport protocol", "HTTP/3 transport layer protocol", "HTTP/3 protocol overview transport"]),
]

# Fixed values: (patterns, expansions) of telecom concepts.
CONCEPTS = [
    ([r"\bşebekeden(?:\s+\w+){0,4}\s+çık\w*", r"\bkayıttan(?:\s+\w+){0,4}\s+çık\w*", r"\bkayıt(?:\s+\w+){0,3}\s+sil\w*", r"\bderegister\w*", r"\bderegistration\b", r"\bde-registration\b", r"\bdetach\w*", r"\b5gs['’]?(?:ten|den)(?:\s+\w+){0,5}\s+ayrıl\w*", r"\bşebekeden(?:\s+\w+){0,5}\s+ayrıl\w*", r"\bnetwork(?:ten|den)?(?:\s+\w+){0,5}\s+ayrıl\w*"],
     ["UE deregistration procedure", "network initiated deregistration", "UE initiated deregistration"]),
    ([r"\bşebekeye(?:\s+\w+){0,3}\s+kayıt", r"\bkayıt\s+ol\w*", r"\bregistration\s+request\b", r"\bregister\w*", r"\bregistration\b"],
     ["5GS registration procedure", "Registration Request", "Registration Management"]),
    ([r"\bşebekeden(?:\s+\w+){0,4}\s+düş\w*", r"\bbağlantı(?:\s+\w+){0,4}\s+kop\w*", r"\bsinyal(?:\s+\w+){0,4}\s+git\w*", r"\bcoverage\s+loss\b", r"\bradio\s+link\s+failure\b"],
     ["radio link failure", "RRC connection release", "loss of coverage"]),
    ([r"\bservice\s+request\b", r"\bservis\s+iste\w*", r"\bservis\s+talep\w*", r"\bbağlantıyı(?:\s+\w+){0,3}\s+tekrar\s+kur\w*", r"\btekrar\s+aktif\w*", r"\bbağlantı(?:yı|yi|yu|yü)?(?:\s+\w+){0,5}\s+yeniden\s+etkinleştir\w*", r"\buplink\b.*\byeniden\s+etkinleştir\w*", r"\buplink\b.*\bservice\s+request\b"],
     ["UE triggered Service Request", "Service Request procedure"]),
    ([r"\bpdu\s+session.*\bkapat\w*", r"\bpdu\s+session.*\bsonlandır\w*", r"\bpdu\s+session.*\brelease\w*", r"\boturum.*\bkapat\w*", r"\boturum.*\bsonlandır\w*", r"\bsession.*\brelease\w*"],
     ["PDU Session Release", "PDU Session Release procedure"]),
    ([r"\bpdu\s+session.*\baç\w*", r"\bpdu\s+session.*\bkur\w*", r"\bpdu\s+session.*\bestablish\w*", r"\boturum\s+aç\w*", r"\bdata\s+oturumu.*\baç\w*", r"\bveri\s+oturumu.*\baç\w*", r"\binternet\s+oturumu.*\baç\w*", r"\bpdu\s+session.*\boluştur\w*", r"\bpdu\s+session.*\bbaşlat\w*"],
     ["PDU Session Establishment", "UE-requested PDU session establishment procedure", "UE Requested PDU Session Establishment"]),
    ([r"\bhandover\b", r"\bhücre(?:\s+\w+){0,3}\s+değiş\w*", r"\bbaz\s+istasyonu(?:\s+\w+){0,3}\s+değiş\w*", r"\bcell\s+change\b", r"\bmobilite\b"],
     ["handover procedure", "UE mobility", "mobility management"]),
    ([r"\b5g\b.*\bmulticast\b.*\bbroadcast\b", r"\bmulticast[-\s]*broadcast\b", r"\bmulticast\b.*\bbroadcast\b", r"\b5mbs\b", r"\bmbs\b.*\bmimari", r"\bmbs\b.*\barchitecture"],
     ["architectural enhancements to the 5G system using NR to support multicast and broadcast communication services", "5G Multicast-Broadcast Services architecture", "Architecture for 5G multicast-broadcast services"]),
    ([r"\bcell\s+broadcast\b.*\biptal\w*", r"\bcell\s+broadcast\b.*\bcancel\w*", r"\bwarning\s+message\b.*\biptal\w*", r"\bwarning\s+message\b.*\bcancel\w*", r"\buyarı\s+mesaj\w*.*\biptal\w*"],
     ["Warning Message Cancel Procedure", "Stop Warning Request", "Cell Broadcast warning message cancellation"]),
    ([r"\bcell\s+broadcast\b", r"\bhücre\s+yayını\b", r"\bacil\s+uyarı\b", r"\bwarning\s+message\b", r"\buyarı\s+mesaj\w*"],
     ["Cell Broadcast", "Public Warning System", "Cell Broadcast warning message"]),
    ([r"\bsms\b", r"\bkısa\s+mesaj\b", r"\bmesaj\s+gönder\w*", r"\bmesaj\s+ilet\w*"],
     ["Short Message Service", "SMS procedure"]),
    ([r"\bauthentication\b", r"\bkimlik\s+doğrula\w*", r"\bdoğrulama\b", r"\bauthenticate\w*"],
     ["UE authentication", "authentication procedure", "identification and authentication"]),
    ([r"\bşebeke\s+seç\w*", r"\boperatör\s+seç\w*", r"\bnetwork\s+selection\b", r"\bplmn\b"],
     ["PLMN selection", "network selection"]),
    ([r"\broaming\w*", r"\bdolaşım\w*", r"\byurt\s+dışında(?:\s+\w+){0,3}\s+şebeke\w*"],
     ["roaming procedure", "VPLMN HPLMN roaming"]),
    ([r"\bacil\s+çağrı\w*", r"\bemergency\s+call\w*", r"\bacil\s+servis\w*"],
     ["emergency call", "emergency services", "emergency registration"]),
]

# Leaving the network, and who starts it.
DEREGISTRATION = [r"\bşebekeden(?:\s+\w+){0,5}\s+çık\w*", r"\bkayıttan(?:\s+\w+){0,5}\s+çık\w*", r"\bkayıt(?:\s+\w+){0,4}\s+sil\w*", r"\bderegister", r"\bderegistration", r"\bde-registration", r"\bdetach", r"\b5gs['’]?(?:ten|den)(?:\s+\w+){0,5}\s+ayrıl\w*", r"\bşebekeden(?:\s+\w+){0,5}\s+ayrıl\w*"]
BY_DEVICE = ([r"\bkendi\s+iste", r"\bkendi\s+taleb", r"\bkendisi\s+başlat", r"\bue\s+initiated", r"\bue-initiated", r"\buser\s+initiated", r"\bterminal\s+initiated"], ["UE initiated deregistration", "UE initiated deregistration procedure", "Deregistration Request"])
BY_NETWORK = ([r"\bşebeke\s+tarafından", r"\bağ\s+tarafından", r"\bnetwork\s+initiated", r"\bnetwork-initiated", r"\bnetwork\s+triggered", r"\bnetwork-triggered", r"\boperatör\s+tarafından"], ["network initiated deregistration", "network initiated deregistration procedure", "network triggered deregistration"])

# Entities of a question, and what is asked of them.
ENTITY = r"\b(amf|smf|upf|udm|ausf|pcf|nssf|nef|nrf|udr|chf|gnb|ng-ran|ran|ue|sim|usim|hss|mme|pgw|sgw|sepp)\b"
ENDPOINT = r"\b(?:ue|amf|smf|upf|ausf|udm|pcf|nssf|af|ng-ran|ran)\b"
REFERENCE_POINT = r"\b(n\d{1,3})\b.*\b(?:referans\s+nokt|reference\s+point)"
SIGNALLING = r"\b(?:sinyalleş\w*|signall?ing)\b"
FUNCTIONALITY = [r"\bgörev\w*", r"\brol\w*", r"\bne\s+işe\s+yarar", r"\bfunction\w*", r"\bduties\b"]
PROCEDURE = [r"\bnasıl\b", r"\badım\w*", r"\bakış\w*", r"\bprosedür\w*", r"\bprocedure\b", r"\bflow\b"]
OVERVIEW = [r"\bnedir\b", r"\btanım\w*", r"\boverview\b", r"\bne\s+demek\b"]
#: Templates over the entities.
FUNCTIONALITY_TEXTS = ["%s network function functionality", "%s functionality includes", "%s network function architecture overview", "functions and responsibilities of %s"]
PROCEDURE_TEXTS = ["%s procedures and flows", "%s operational call flow"]
OVERVIEW_TEXTS = ["%s network function overview", "%s architecture definition"]
OTHER_TEXTS = ["%s 5GS architecture specification"]
#: Templates over a reference point, and over it and two endpoints.
SIGNALLING_PAIR_TEXTS = ["%1$s NAS signalling between %2$s and %3$s", "%1$s reference point between %2$s and %3$s", "5GS %1$s interface NAS protocol %2$s %3$s"]
SIGNALLING_TEXTS = ["%1$s NAS signalling", "5GS %1$s interface NAS protocol", "%1$s reference point signalling"]
POINT_TEXTS = ["%1$s reference point", "%1$s reference point 5G System architecture", "%1$s reference point description"]
#: The other entities: (all patterns must match, expansions), in order.
ENTITY_CASES = [
    ([r"\b(?:3gpp\s+)?ts\s*23[.\s_-]*502\b"], ["Procedures for the 5G System Stage 2", "5G System procedures and flows", "5GS procedures"]),
    ([r"idempoten|\bput\b.*\bdelete\b|\bdelete\b.*\bput\b"], ["Idempotent Methods", "multiple identical requests same intended effect", "PUT DELETE idempotent methods"]),
    ([r"quic", r"\b(?:stream|akış)"], ["QUIC streams independent streams", "multiple QUIC streams head-of-line blocking", "QUIC Streams RFC 9000"]),
    ([r"quic", r"\b(?:udp|datagram)"], ["QUIC packet is carried in a UDP datagram", "QUIC UDP datagrams transport", "QUIC packet coalescing UDP datagram"]),
    ([r"ngap"], ["NG Application Protocol purpose", "NGAP services NG-RAN AMF", "NGAP protocol overview"]),
    ([r"nas", r"5g"], ["5GS non-access stratum protocol scope", "5GS NAS protocol functions", "5G mobility management session management NAS"]),
]

# Answer types and their patterns.
ANSWER_TYPES = [
    ("STANDART / DOKÜMAN", [r"\bhangi(?:\s+\w+){0,3}\s+(?:standart|standard|doküman|dokuman|rfc|belge|şartname|sartname|spec|specification)\w*", r"\bhangi\s+(?:ietf\s+|3gpp\s+|etsi\s+)?(?:standart|standard|doküman|dokuman|rfc|belge|şartname|sartname|spec|specification)\w*", r"\b(?:standart|standard|doküman|dokuman|rfc|şartname|spec)\w*\s+tanımlan\w*", r"\brfc['’]?(?:de|da)\s+tanımlan\w*", r"\bwhich(?:\s+\w+){0,3}\s+(?:rfc|standard|document|specification)\b"]),
    ("ARAYÜZ / REFERANS NOKTASI", [r"\bhangi(?:\s+\w+){0,4}\s+arayüz\w*", r"\bhangi(?:\s+\w+){0,4}\s+interface\w*", r"\bhangi(?:\s+\w+){0,4}\s+referans\s+nokt\w*", r"\breferans\s+nokt\w*[^?]{0,60}\b(?:hangisi\w*|nedir|adı\s+ne)\b", r"\b\w+\s+ile\s+\w+\s+arasındaki\s+referans\s+nokt\w*", r"\bwhich(?:\s+\w+){0,3}\s+reference\s+point\b"]),
    ("PROTOKOL", [r"\bhangi(?:\s+\w+){0,3}\s+protokol\w*", r"\bwhich(?:\s+\w+){0,3}\s+protocol\b", r"\btransport\s+protocol\b", r"\btaşıma\s+protokol\w*", r"\bhangi\s+protocol\b"]),
    ("NETWORK FUNCTION", [r"\bhangi(?:\s+\w+){0,4}\s+(?:ağ\s+fonksiyonu|network\s+function|nf)\b", r"\bhangi\s+nf\b", r"\bwhich(?:\s+\w+){0,4}\s+network\s+function\b", r"\b(?:sorumlu|yürüten|sağlayan|gerçekleştiren)\s+(?:ağ\s+fonksiyonu|network\s+function|nf)\b", r"\b(?:ağ\s+fonksiyonu|network\s+function|nf)\s+(?:sorumlu|yürüt|gerçekleştir|yapar)"]),
    ("PROSEDÜR", [r"\bhangi(?:\s+\w+){0,3}\s+prosedür\w*", r"\bwhich(?:\s+\w+){0,3}\s+procedure\b", r"\bhangi\s+prosedürü\s+(?:başlat|kullan|yürüt)\w*"]),
    ("MESAJ", [r"\bhangi(?:\s+\w+){0,3}\s+mesaj\w*", r"\bne\s+gönder\w*", r"\bhangi(?:\s+\w+){0,3}\s+request\b", r"\bhangi(?:\s+\w+){0,3}\s+message\b"]),
    ("SİSTEM", [r"\bhangi\s+sistem\w*", r"\bhangi\s+şebeke\w*", r"\bhangi\s+network\b", r"\bwhich\s+system\b"]),
    ("AMAÇ / İŞLEV", [r"\bne\s+işe\s+yar\w*", r"\bamacı\s+ne", r"\bhangi\s+amaçla\b", r"\bne\s+amaçla\b", r"\bgörevi\s+ne", r"\bneden\s+kullan\w*", r"\bwhat\s+is\s+the\s+purpose\b", r"\bwhat\s+does\b"]),
    ("KOŞUL / ZAMAN", [r"\bne\s+zaman\b", r"\bhangi\s+durum\w*", r"\bhangi\s+koşul\w*", r"\bwhen\b", r"\bunder\s+what\s+condition"]),
    ("DEĞER / LİMİT", [r"\bkaç\b", r"\bmaksimum\b", r"\bminimum\b", r"\bmaximum\b", r"\blimit\b", r"\bdeğeri\s+ne", r"\bkaç\s+basamak", r"\bkaç\s+bit", r"\bkaç\s+byte", r"\bkaç\s+saniye", r"\bhow\s+many\b", r"\bhow\s+much\b"]),
]
GENERAL = "GENEL TEKNİK BİLGİ"

# Marks of a question that asks for an explanation.
EXPLANATORY = ["ne işe yar", "amacı", "amaçla", "görevi", "neden", "nasıl", "ne demek", "ne anlama", "avantaj", "hangi tür", "ne taşın", "neyi taşın", "ne yönet", "hangi işlem", "örnek", "içeri", "davranış", "açıkla", "anlat", "karşılaştır", "what does", "what is the purpose", "why", "how does", "explain"]
# Answer types that allow an exact lookup, and their patterns.
EXACT_LOOKUP = {
    "SİSTEM": [r"\bhangi(?:\s+\w+){0,3}\s+sistem\w*", r"\bwhich(?:\s+\w+){0,3}\s+system\b"],
    "MESAJ": [r"\bhangi(?:\s+\w+){0,3}\s+mesaj\w*", r"\bhangi(?:\s+\w+){0,3}\s+(?:request|message)\b", r"\bne\s+gönder\w*"],
    "PROSEDÜR": [r"\bhangi(?:\s+\w+){0,3}\s+prosedür\w*", r"\bwhich(?:\s+\w+){0,3}\s+procedure\b"],
    "STANDART / DOKÜMAN": [r"\bhangi(?:\s+\w+){0,4}\s+(?:standart|standard|doküman|dokuman|rfc|belge|şartname|sartname|spec|specification)\w*", r"\bwhich(?:\s+\w+){0,4}\s+(?:standard|document|rfc|specification)\b"],
    "PROTOKOL": [r"\bhangi(?:\s+\w+){0,4}\s+protokol\w*", r"\bwhich(?:\s+\w+){0,4}\s+protocol\b"],
    "DEĞER / LİMİT": [r"\bkaç\b", r"\b(?:maksimum|minimum|maximum|limit)\b", r"\bhow\s+(?:many|much)\b"],
}
# Titles of clauses without content.
LOW_VALUE_TITLES = ["references", "normative references", "informative references", "bibliography", "foreword", "change history", "history", "table of contents", "contents"]
# Technical anchors of a question.
ANCHOR = r"\b(?:HTTP/3|HTTP|QPACK|QUIC|NGAP|NAS|5GS|5G|N\d{1,3}|UE|AMF|SMF|UPF|PUT|DELETE|RFC\s*\d+|\d{4,5}|idempoten\w*|multicast|broadcast|warning\s+message)\b"

# Organisations of reference lines, in order: (name, pattern, groups that make the code; none: all of it).
REFERENCE_PATTERNS = [
    ("3GPP", r"(?i)3GPP\s+(TS|TR)\s*(\d{2}\.\d{3})(?:\s+Version\s+[\d.]+)?", (1, 2)),
    ("ETSI", r"(?i)ETSI\s+(TS|EN|TR)\s*(\d{3}\s?\d{3})", (1, 2)),
    ("IETF", r"(?i)(?:IETF\s+)?RFC\s*(\d{3,5})", (1,)),
    ("ITU-T", r"(?i)ITU-T\s+Rec(?:ommendation)?\.?\s*([A-Z]\.\d+)", (1,)),
    ("ATIS", r"(?i)ATIS-(\d{7}(?:\.v\d{3})?)", (1,)),
    ("GSMA", r"\bGSMA\s+([A-Z]{2}\.\d{1,3})\b", (1,)),
    ("IEEE", r"(?i)IEEE\s+(\d{2,4}(?:\.\d+[a-z]?)?)", ()),
    ("O-RAN", r"(?i)O-RAN\.[A-Z0-9\-]+", ()),
    ("BBF", r"(?i)(?:BBF|TR)-\d{3}", ()),
    ("MEF", r"(?i)MEF\s+(\d{1,3})", ()),
]
# Constants of retrieval and chunking.
RRF_K = 60.0
CANDIDATES_PER_VARIANT, MAX_CANDIDATES, MAX_VARIANTS = 35, 12, 4
DISTANCE_THRESHOLD = 0.43
CHUNK_CHARS, CHUNK_OVERLAP = 2400, 300
BM25_K1, BM25_B, LEAST_IDF = 1.2, 0.75, 1e-6

# Marks of meeting contributions, and where a document's identity stands.
MEETING_MARKS = ["3gpp tsg-", "meeting #", "sp-", "rp-", "cp-", "gp-"]
MEETING_LINES, IDENTITY_LINES = 50, 80
# Network functions whose naming asks for a second search, and words that are no end of a reference point.
SECOND_SEARCH_FUNCTIONS = ["amf", "smf", "upf", "ausf", "udm", "pcf", "nssf", "nrf"]
NO_ENDPOINTS = ["5G", "5GS", "TS", "TR", "RFC", "REFERENCE", "POINT", "INTERFACE", "HTTP", "IETF", "ILE", "ARASINDAKI", "ARASINDA", "HANGISIDIR", "NEDIR", "HANGI", "BETWEEN", "AND", "THE"]
RAN_NAMES = ["GNB", "GNODEB", "ENB", "NG-RAN", "(R)AN"]
# Phrases for questions of known intent: (lists of words of which each list needs one, words that must not be there, phrases).
PRECISION_PHRASES = [
    ([["service request"]], [], ["Service Request procedure is used"]),
    ([["uplink"], ["yeniden etkinleştir", "tekrar etkinleştir", "tekrar aktif", "activate", "reactivate"]], [], ["Service Request procedure is used"]),
    ([["http/3", "http3"], ["rfc", "standart", "standard", "doküman", "document", "tanımlan", "defined"]], ["websocket", "qpack"], ["This document defines HTTP/3"]),
    ([["quic"], ["kayıp", "loss", "congestion", "recovery"]], [], ["This document describes loss detection and congestion control mechanisms for QUIC"]),
    ([["cell broadcast", "warning message", "uyarı mesaj"], ["iptal", "cancel", "stop", "durdur"]], [], ["The cancel warning message delivery procedure takes place"]),
    ([["5g"], ["mimarisi", "architecture", "sistem mimarisi"], ["şartname", "sartname", "standart", "standard", "doküman", "document"]], [], ["System Architecture for the 5G System", "3GPP TS 23.501"]),
]
# Answer sentences by type.
ANSWER_SENTENCES = {
    "SİSTEM": "İlgili sistem %s'dır.", "PROSEDÜR": "İlgili prosedür %s'dür.", "MESAJ": "İlgili mesaj %s'tır.", "STANDART / DOKÜMAN": "İlgili standart veya doküman %s'dır.",
    "ARAYÜZ / REFERANS NOKTASI": "İlgili arayüz veya referans noktası %s'dır.", "PROTOKOL": "İlgili protokol %s'dür.", "NETWORK FUNCTION": "İlgili network function %s'dır.", "DEĞER / LİMİT": "Kaynakta belirtilen değer %s'dır.",
}
SYSTEM_USED, SYSTEM_FOR = "%s %s içinde kullanılır.", "%s için ilgili sistem %s'dır."
SYSTEM_QUESTION = r"\bhangi\s+(?:sistem(?:de|den|da|dan)?|şebeke(?:de|den|da|dan)?|network(?:te|ten|de|den)?)\b"

# What candidates of each answer type look like (first group), in order.
CANDIDATE_PATTERNS = {
    "SİSTEM": [r"\b((?:\dG|[A-Z][A-Z0-9\-]{1,}|[A-Z][A-Za-z0-9\-]+)(?:\s+[A-Z][A-Za-z0-9\-]+){0,3}\s+(?:System|system|Subsystem|subsystem))\b"],
    "PROSEDÜR": [r"(?i)\b((?:(?:(?:UE|network)[-\s]+initiated|UE[-\s]+requested|network[-\s]+requested)(?:\s+[A-Za-z0-9/\-]+){0,5}\s+procedure)|(?:(?!(?:The|A|An)\b)(?:[A-Za-z0-9/\-]+\s+){1,3}procedure))\b"],
    "MESAJ": [r"\b((?:(?:[A-Z][A-Z0-9/\-]*\s+){0,4}(?:REQUEST|RESPONSE|ACCEPT|REJECT|COMMAND|COMPLETE|NOTIFICATION|INDICATION|REPORT|MESSAGE))|(?:(?:[A-Z][A-Za-z0-9/\-]*\s+){0,4}(?:Request|Response|Accept|Reject|Command|Complete|Notification|Indication|Report|Message)))\b"],
    "ARAYÜZ / REFERANS NOKTASI": [r"\b([A-Za-z][A-Za-z0-9\-]{0,15})\s*:\s*(?i:Reference\s+point)\b", r"\b([A-Za-z][A-Za-z0-9\-]{0,15})\s+(?i:(?:reference\s+point|interface))\b", r"\b(?i:(?:reference\s+point|interface))\s+([A-Za-z][A-Za-z0-9\-]{0,15})\b"],
    "PROTOKOL": [r"(?i:(?:application|transport)?\s*protocol)\s*\(([A-Z][A-Z0-9/\-]{1,12})\)", r"\b([A-Z][A-Z0-9.+/\-]{1,12})\s+(?i:transport\s+protocol)\b", r"\b([A-Za-z][A-Za-z0-9.+/\-]{1,20})\s+(?i:protocol)\b"],
    "NETWORK FUNCTION": [r"(?i:(?:[A-Za-z][A-Za-z0-9/\-]*\s+){1,8}Function)\s*\(([A-Z][A-Z0-9\-]{1,10})\)", r"\b([A-Z][A-Z0-9\-]{1,10})\s+(?i:(?:Network\s+)?Function)\b", r"\b((?:[A-Z][A-Za-z0-9/\-]*\s+){0,4}[A-Z][A-Za-z0-9/\-]*\s+[Ff]unction)\b"],
    "DEĞER / LİMİT": [r"(?i)\b(\d+(?:\.\d+)?\s*(?:ms|s|sec|second|seconds|minute|minutes|hour|hours|day|days|bit|bits|byte|bytes|octet|octets|digit|digits|character|characters|Hz|kHz|MHz|GHz|dB|dBm|%))\b"],
}
#: What every match of a slow pattern ends with.
CANDIDATE_ENDS = {CANDIDATE_PATTERNS["NETWORK FUNCTION"][0]: r"(?i:Function)\s*\([A-Z][A-Z0-9\-]{1,10}\)"}
# Candidates that say nothing.
GENERIC_CANDIDATES = ["between", "procedure", "the procedure", "this procedure", "a procedure", "procedure procedure", "the protocol", "this protocol", "a protocol", "protocol", "application protocol", "transport protocol", "layer protocol", "transport", "application", "layer", "provides", "this", "the function", "this function", "a function", "function", "to", "from", "and", "with", "the", "for", "in", "of"]
# Documents that a text refers to.
DOCUMENT_RELATION = r"(?i)\b(?:defined|specified|described|documented)\s+(?:in|by)\s+((?:3GPP\s+)?(?:TS|TR)\s*\d+(?:\.\d+)+|RFC\s*\d+)\b"
DOCUMENT_IDENTIFIER = r"(?i)\b((?:3GPP\s+)?(?:TS|TR)\s*\d+(?:\.\d+)+|RFC\s*\d+)\b"
#: What every match of these two and of the titles below has.
CITED = r"(?i)(?:TS|TR|RFC)\s*\d"

# Fixed values of the answer guard: patterns, words that count as grounded anyway, and its sentences.
GUARD_IDENTIFIER = r"\b((?:[A-Z]{2,}[A-Z0-9/.-]*|[A-Z][a-z0-9]*[A-Z][A-Za-z0-9/.-]*|N\d{1,3}))\b"
GUARD_STATUS = r"(?<!\d)([1-5]\d{2})(?!\d)"
GUARD_ABBREVIATION = r"\b([A-Z][A-Za-z0-9/.-]{1,}\s*\([^)]+\))"
GUARD_DOCUMENT = r"(?i)\b(?:TS|TR|RFC|EN|ES|Recommendation)\s*[A-Z]?\s*\d[\d.\-]*\b"
GUARD_SYSTEM = r"\b((?:\dG|[A-Z][A-Z0-9\-]{1,})(?:\s+[A-Za-z0-9\-]+){0,3}\s+[Ss]ystem)\b"
GUARD_NOT_DOCUMENT = ["request", "response", "accept", "reject", "procedure", "referans", "reference point", "protocol"]
GUARD_DOCUMENT_WORDS = ["standart", "standard", "doküman", "document", "specification"]
ALLOWED_IDENTIFIERS = ["kaynak", "kaynaklar", "standart", "standartlar", "doküman", "dokuman", "madde", "bölüm", "bolum", "tablo", "şekil", "sekil", "ek", "clause", "section", "annex", "table", "figure", "session", "request", "response", "accept", "reject", "procedure", "message", "sdf", "gating", "qos", "pdu", "dnn", "ue", "ran", "ng-ran", "gnb", "amf", "smf", "upf", "ausf", "udm", "pcf", "nssf", "nrf", "nas", "n1", "n2", "n3", "n4", "n6", "n9", "n11", "n12", "n14", "n15", "n26", "n50", "f1", "e1", "x2", "xn", "amm", "http", "tcp", "udp", "sctp", "quic", "ip", "ipv4", "ipv6", "tai", "pra", "mbs"]
GUARD_REASONS = {
    "empty": "Model boş cevap üretti.",
    "document": "Standart/doküman kodu, sorulan teknik varlığın yerine cevap olarak kullanılmış.",
    "claims": "Cevapta kaynaklarda veya soruda bulunmayan teknik identifier/değer kullanılmış: ",
    "system": "Sistem sorusuna verilen cevap, kaynak metinde açıkça System olarak geçen teknik varlıklardan hiçbirini içermiyor.",
}
GUARD_FALLBACK_SYSTEM = "Kaynak metne göre ilgili sistem %s olarak belirtilir."
GUARD_FALLBACK = "Kaynaklar bulundu ancak doğrudan ve güvenilir bir cevap oluşturulamadı."

# Words of a text, words joined by a slash, and words that say nothing about a question's subject.
WORD = r"[A-Za-z0-9ÇĞİÖŞÜçğıöşü][A-Za-z0-9ÇĞİÖŞÜçğıöşü.+/_\-]*"
SLASHED = r"([A-Za-z0-9]+)/([A-Za-z0-9]+)"
STOP_WORDS = ["acaba", "ama", "bir", "bu", "da", "de", "den", "dan", "hangi", "için", "ile", "mi", "mı", "mu", "mü", "nasıl", "ne", "nedir", "neden", "olarak", "ve", "veya", "a", "an", "and", "are", "as", "at", "be", "between", "by", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "used", "using", "what", "which", "with"]

# Words of a sentence that speak for an answer type, and their points.
SENTENCE_CUES = {
    "SİSTEM": ([" system", " subsystem"], 2.5), "PROSEDÜR": (["procedure"], 2.5), "MESAJ": (["request", "response", "message", "command", "notification", "indication", "accept", "complete"], 2.0),
    "ARAYÜZ / REFERANS NOKTASI": (["reference point", "interface"], 2.5), "PROTOKOL": (["protocol", "transport"], 2.5), "NETWORK FUNCTION": (["function", "registration management", "responsible for"], 2.5),
}
VALUE_CUE = 3.0
# Acronyms, those that name no end of a reference point in a question, and names of the radio network.
ACRONYM = r"\b[A-Z][A-Z0-9\-]{1,10}\b"
WHOLE_ACRONYM = r"^[A-Z][A-Z0-9/\-]{1,12}$"
NO_QUESTION_ENDS = ["5G", "5GS", "4G", "LTE", "EPC", "ILE", "VE", "VEYA", "ARASINDA", "ARASINDAKI", "HANGISIDIR", "NEDIR"]
RADIO_ENDS = ["(R)AN", "RAN", "NG-RAN", "GNB", "G-NODE-B", "GNODEB", "ENB"]
# Sentences that tell a reference point's ends: (pattern, group of the label, groups of the ends).
POINT_RELATIONS = [
    (r"(?i)\b([A-Za-z]{1,5}\d+[A-Za-z]?)\s*:\s*Reference\s+point\s+between\s+(?:the\s+)?(\(R\)AN|NG-RAN|RAN|gNB|[A-Z][A-Z0-9\-]{1,12})\s+and\s+(?:the\s+)?(\(R\)AN|NG-RAN|RAN|gNB|[A-Z][A-Z0-9\-]{1,12})\b", 1, (2, 3)),
    (r"(?i)\bReference\s+point\s+between\s+(?:the\s+)?(\(R\)AN|NG-RAN|RAN|gNB|[A-Z][A-Z0-9\-]{1,12})\s+and\s+(?:the\s+)?(\(R\)AN|NG-RAN|RAN|gNB|[A-Z][A-Z0-9\-]{1,12})\s*[:\-]\s*([A-Za-z]{1,5}\d+[A-Za-z]?)\b", 3, (1, 2)),
]
POINT_LABEL = r"^[A-Za-z]{1,5}\d+[A-Za-z]?$"
BOTH_ENDS, ONE_END, SURE_RELATION = 24.0, 4.0, 20.0
# Fixed values of network functions: acronyms that are none, words of a question that are no anchors, phrases of duties, long forms that speak against.
NO_FUNCTIONS = ["UE", "NF", "5G", "5GS", "RAN", "NG-RAN", "PLMN", "PDU", "NAS", "TS", "TR", "RFC", "IE", "IP"]
NO_ANCHORS = ["5g", "5gs", "network", "function", "nf", "hangi", "işlemlerini", "işlem", "işlemleri", "yürütür", "yürütmektedir", "gerçekleştirir", "responsible", "functionality"]
DUTIES = ["responsible for", "is responsible", "performs", "shall perform", "handles", "shall handle", "provides", "shall provide", "management function", "registration management", "ip address allocation"]
NO_FUNCTION_FORMS = ["service", "protocol", "message", "procedure", "request", "response", "interface", "session", "information element"]
ROLE, EACH_ANCHOR, DUTY, NEAR, NEAR_CHARS, SURE_DUTY = 12.0, 5.0, 5.0, 6.0, 180, 10.0
# What a question and a message must say for the message's direction to count.
SENDING, SENT, ANSWERED, DIRECTION = ["başlat", "istek", "gönder", "talep", "establish", "initiate"], ["request"], ["accept", "reject", "response", "complete"], 8.0
# Points of a candidate: place of its source, title, shape of its label, echo of the question, context, repeats.
CONTEXT_CHARS, EACH_CONTEXT_WORD, MOST_CONTEXT_WORDS = 180, 2.0, 5
SHAPES = {"ARAYÜZ / REFERANS NOKTASI": (POINT_LABEL, 6.0), "PROTOKOL": (WHOLE_ACRONYM, 6.0), "NETWORK FUNCTION": (WHOLE_ACRONYM, 5.0)}
PROTOCOL_ECHO, FUNCTION_ECHO = 9.0, 7.0
REPEATED, DOCUMENT_REPEATED = 0.75, 0.5
# Answer types whose confidence needs strong evidence, and the limits of confidence.
RISKY_TYPES = ["ARAYÜZ / REFERANS NOKTASI", "PROTOKOL", "NETWORK FUNCTION", "DEĞER / LİMİT", "STANDART / DOKÜMAN", "MESAJ"]
SURE_SCORE, SURE_MARGIN, MEDIUM_SCORE, TIE, TIE_OCCURRENCES, MOST_CANDIDATES = 7.0, 1.0, 4.0, 0.001, 2, 5

# Fixed values of document candidates: words of a question that are no subject, patterns, points.
NO_SUBJECT = ["rfc", "standart", "standard", "doküman", "document", "specification", "protocol", "protokol", "hangi", "tanımlanır", "tanımlanan", "defined", "3gpp", "ietf", "ts", "tr"]
NO_DIRECT_SUBJECT = ["rfc", "standart", "standard", "doküman", "document", "specification", "protocol", "protokol", "transport", "tanımlanır", "tanımlanan", "hangi", "ietf"]
EXTENDS = r"(?i)\b(?:subprotocol|extension|upgrade\s+over|bootstrapping|sip\s+uri)\b"
SELF_DEFINITION = r"(?i)\b(?:this document|the present document)\s+(?:defines|specifies|describes)\b"
DEFINED_IN = r"(?i)\b(?:defined|specified|described)\s+(?:in|by)\b"
OWN_NUMBERS = [(["http/3", "http3"], "9114", 35.0), (["quic"], "9000", 35.0)]
RFC_TITLE = r'(?i)["“]([^"”]{4,200})["”]\s*,?\s*RFC\s*0*(\d+)'
SPEC_TITLE = r'(?i)\b(?:3GPP\s+)?(TS|TR)\s*(\d+(?:\.\d+)+)\s*:\s*["“]([^"”]{4,220})["”]'
REFERENCE_SECTION = r"(?i)^\s*(?:Normative\s+|Informative\s+)?References\b"
IDENTIFIER_CHARS = 220
RELATION_POINTS, TITLE_POINTS, CORE_TITLE_POINTS, IDENTIFIER_POINTS, RELATION_BONUS = 16.0, 26.0, 40.0, 6.0, 8.0
CORE_TITLE, CORE_NUMBER = "system architecture", "23.501"
# Words that a document search leaves out.
NO_DOCUMENT_SEARCH = ["this", "the", "document", "defines", "specifies", "protocol", "overview"]
DOCUMENT_HITS, FALLBACK_HITS, FALLBACK_MOST = 15, 20, 20

# An expansion in parentheses behind a name, and the prompt that asks for a better reply.
EXPANSION = r"\b([A-Z][A-Za-z0-9/.-]{1,})\s*\(([^)]+)\)"
REPAIR_NO_TERMS = "Yok"
REPAIR_PROMPT = """KULLANICI SORUSU:
%s

BEKLENEN CEVAP TÜRÜ:
%s

ÖNCEKİ CEVAP:
%s

ÖNCEKİ CEVAPTA TESPİT EDİLEN HATA:
%s

KAYNAKTA TESPİT EDİLEN İLGİLİ TEKNİK TERİMLER:
%s

KAYNAKLAR:
%s

Önceki cevabı düzelt.

Kurallar:
- Yalnızca kaynakları kullan.
- Beklenen cevap türünü değiştirme.
- İlk cümlede doğrudan cevabı ver.
- Standart/doküman kodunu sistem, prosedür, mesaj, protokol veya arayüz yerine koyma.
- Kaynakta System olarak geçen bir varlık sistem sorusunun cevabıysa onu teknik anlamını bozmadan kullan.
- Kullanıcının sormadığı ayrıntıları ekleme.
- Beklenen cevap türü SİSTEM ise ve yukarıda "KAYNAKTA TESPİT EDİLEN İLGİLİ TEKNİK TERİMLER" listesinde System olarak tanımlanan bir varlık varsa, sistem cevabını bu kaynak terimine göre oluştur.
- Doğal Türkçe cümle kullan."""
# Sites of standards bodies, to which a web search is bound.
STANDARDS_SITES = ["3gpp.org", "etsi.org", "ietf.org", "itu.int", "gsma.com", "atis.org"]

# Fixed values of documents: how a 3GPP text states its own name, where its list of references begins and what follows it, and a street
# address that looks like a clause (organisation, clause, part of the title).
STATED_DOCUMENT = r"(?i)\b3GPP\s+(TS|TR)\s+(\d{2}\.\d{3})\b"
FIRST_REFERENCE = r"\[1\]\s+"
AFTER_REFERENCES = ["1.2\tAbbreviations", "1.2 Abbreviations"]
COVER_NOISE = ["ETSI", "650", "route des lucioles"]
# Fixed values of decisions: words for reference points, functions that a question may ask for, those that stand for another one, answers
# that are documents, points of a title for introducing its document, and words of a question for where something is used.
POINT_WORDS = ["referans nokta", "reference point"]
ASKED_FUNCTION = r"(?i)\b(AMF|SMF|UPF|AUSF|UDM|PCF|NSSF|NRF)\b"
RIVAL_FUNCTIONS = ["AMF", "SMF", "UPF"]
ANSWERED_RFC, ANSWERED_SPEC = r"(?i)^RFC\s+(\d+)$", r"(?i)^(3GPP|ETSI)\s+(TS|TR)\s+([\d.]+)$"
TITLE_QUALITY = [(["scope"], 10.0), (["introduction", "overview"], 7.0), (["reference"], -10.0)]
USED_WORDS = ["kullan", "çalış", "yer al"]
# Fixed values of the answer guard: the short and long forms in which a reply may name a system.
SYSTEM_SUFFIX, SYSTEM_FORM, FIFTH_SYSTEM, FIFTH_SHORT = " system", " sistemi", "5g system", "5gs"

# Fixed values of the guidance for a prompt.
GUIDANCE = "BEKLENEN CEVAP TÜRÜ: %s\nCOMPOSER GÜVENİ: %s\nKAYNAKTAN ÇIKARILAN ANA CEVAP: %s"
GUIDANCE_NO_ANSWER, GUIDANCE_FACTS, GUIDANCE_FACT = "BELİRSİZ", "DOĞRUDAN DESTEKLEYİCİ KAYNAK CÜMLELERİ:", "- [%s | %s] %s"
