"""Fixed values of the report domain: taxonomies and word lists, as plain literals.

Every operator takes its lists as parameters; these are the defaults.
"""

# ---- Fixed values -----------------------------------------------------------


#: Hazard categories and their phrases.
HAZARDS = {
    "energy_isolation": ["isolation", "electrical", "energized", "lockout", "tagout", "live circuit", "live component", "de-energized", "loto", "switchboard", "breaker", "switchgear", "arc flash", "live wire", "high voltage"],
    "hot_work": ["hot work", "welding", "cutting", "grinding", "open flame", "torch", "spark"],
    "confined_space": ["confined space", "gas test", "atmospheric", "asphyxiation", "tank entry", "vessel entry", "toxic gas", "oxygen deficiency", "h2s"],
    "line_of_fire": ["line of fire", "suspended load", "swinging", "dropped object", "pinch point", "high pressure line", "recoil", "pressurized line"],
    "safe_mechanical_lifting": ["crane", "lifting", "rigging", "hoist", "sling", "shackle", "winch", "rigging operation"],
    "working_at_height": ["height", "scaffolding", "harness", "elevated platform", "ladder", "manlift", "fall arrest", "monkey board", "fell from", "fall from height", "falling from height", "fell off", "fell down", "risk of falling", "fall hazard"],
    "driving": ["vehicle", "driving", "traffic", "reversing", "forklift", "collision", "haulage"],
    "excavation": ["excavation", "trench", "buried utility", "digging", "cave-in", "shoring"],
}

#: Activity groups and their phrases.
ACTIVITIES = {
    "maintenance": ["maintenance", "process equipment", "servicing", "overhaul", "switchgear servicing", "panel inspection"],
    "hot_work_activity": ["hot work", "welding", "process line", "pipe fabrication", "torch cutting"],
    "lifting_activity": ["lifting operation", "mobile crane", "lifting", "rigging operation", "crane lift"],
    "confined_activity": ["confined space entry", "tank cleaning", "vessel inspection", "vessel entry"],
    "vehicle_activity": ["vehicle movement", "plant premises", "driving", "transportation"],
    "excavation_activity": ["excavation", "buried utility line", "trenching"],
    "electrical_activity": ["electrical panel", "substation", "switchgear", "transformer", "switchboard"],
    "scaffolding_activity": ["scaffolding erection", "scaffold dismantling", "height work", "scaffolding"],
    "pipeline_activity": ["pipeline pigging", "pigging operation", "pipeline maintenance"],
    "inspection_activity": ["routine equipment inspection", "routine walk-around", "routine inspection", "routine maintenance", "morning rounds", "inspection"],
    "housekeeping_activity": ["routine housekeeping", "housekeeping", "workshop cleaning", "cleaning"],
    "testing_activity": ["hydrotesting", "line testing", "pressure testing", "line pressurization"],
}

#: Phrases that place a person near the hazard.
EXPOSURES = {
    "direct_proximity": ["at the point of exposure", "hands inside", "in front of", "astride", "working inside the affected", "arm's length", "arms length", "was adjusting the belt", "detection was inhibited", "the disabled trip was meant to protect", "obstructed access route", "walked through the affected", "affected walkway", "downwind of", "splash zone", "at the open edge", "blind spot", "within the marked", "immediately below", "directly beside", "within reach of", "in line with", "inside the protected zone", "immediate work zone", "working inside the affected area", "in contact with", "head inside", "ahead of the entry check", "on the discharge side", "under the raised section", "swing radius", "in the path of", "in the vehicle route", "while it was still turning", "bung already open", "next to the exposed source", "cordoned", "unprotected platform", "guardrail removed", "without being clipped", "still live", "with the feeder", "inside the vapour", "inside the vapor", "next to the leak", "next to the cutting", "within the immediate", "within the immediate hazard zone", "directly beneath", "directly under", "within arm's reach", "inside the equipment", "standing within", "in the line of fire", "in direct path", "crew entered", "vessel entry", "tank entry", "inside the vessel", "worker entered", "personnel entered", "entered the vessel", "entered the confined space", "worker below", "directly under crane arm", "under crane arm", "beneath the load", "underneath the load", "under the suspended load", "worker was exposed", "worker was exposed to", "exposed to an energized electrical component", "was exposed to electrical energy", "exposed to electrical energy", "personnel were exposed", "worker exposed to", "work was exposed to", "exposed to the live component", "struck by", "was struck by", "struck the", "was struck", "pinned by", "was pinned by", "pinned the", "was pinned", "crushed between", "crushed by", "was crushed", "trapped between", "trapping the", "caught between", "overcome by", "was overcome by", "hit by", "was hit by", "collided with", "resulting in fatal injuries", "resulting in serious injury", "resulting in personal injury", "sustained crush injuries", "sustained serious injuries", "sustained fatal injuries", "fatally injured", "fatally trapping"],
    "indirect_proximity": ["nearby", "in the vicinity", "general work area", "adjacent area", "around the perimeter", "metres away", "meters away", "behind the barricade", "adjacent deck", "adjacent module", "adjacent", "passing through the area", "moving through the area", "not directly in the hazard path", "another team was working", "intermittently", "outside the marked zone", "screened from the hazard", "stood back from", "nearest worker", "personnel in the area", "team was sent to assess", "response team entered"],
}

#: Phrases that say that nobody was near.
NO_EXPOSURE = ["suspended before anyone entered", "nobody was exposed", "work had not yet started", "clear of workers during the activity", "had been evacuated", "no one was present", "was unmanned", "had been withdrawn", "for the duration of the task", "no personnel were in the vicinity", "no personnel in the vicinity", "area was clear of workers", "area clear of workers", "area was clear of all personnel", "area clear of all personnel", "area was cleared of all workers", "area was cleared of workers", "area was cleared of all personnel", "area was clear", "area clear", "no workers were present", "no personnel present", "all personnel were evacuated", "all workers evacuated", "barricaded with no entry", "no personnel exposed", "exclusion zone established with no personnel inside"]

#: Words that confirm a barrier.
CONFIRMATIONS = ["confirmed", "verified", "re-verified", "reverified", "established", "completed", "clear", "tagged", "checked", "rechecked", "signed", "enforced", "located", "sign-off", "secured", "tested safe", "running", "in place", "active", "certified", "applied"]

#: Words that negate a confirmation, and pairs of words that do.
NEGATIONS = ["no", "not", "never", "nor", "lack", "absence", "unable", "without", "missing"]

#: Pairs.
NEGATION_PAIRS = ["could not", "did not", "was not", "were not", "failed to", "failed to apply"]

#: Phrases that say that a barrier was absent.
ABSENCES = ["nobody had", "no one had", "nobody has", "no one has", "had not been", "have not been", "was never", "were never", "no evidence of", "had not been established", "was not applied", "had been dismantled", "not reinstated", "was absent", "deliberately set aside", "was not in place", "there was no", "proceeded without", "started work before", "was bypassed", "no isolation", "no exclusion zone", "without a permit", "no permit", "not sighted", "isolation not done", "not isolated", "lockout not applied", "tagout not applied", "no gas test", "gas test not done", "no harness", "without harness", "unsecured", "not barricaded", "without hot work permit", "without fire watch", "no fire watch", "missing permit", "tag missing", "scaffold tag missing", "barrier bypassed", "guard removed", "no loto", "without loto", "loto not done", "safety harness not worn", "no barrier", "was not in use", "were not in use", "not in use", "was not attached", "were not attached", "not attached to", "had not made provision for", "did not make provision for", "failure to follow", "not clearly defined", "not established", "barrier failed", "barrier had failed", "barriers failed", "had not included", "did not include", "had not been held", "was not held", "were not held", "was not positioned to", "not fully latched", "not properly latched", "only partially latched"]

#: Phrases that leave a barrier in doubt.
UNCERTAINTIES = ["could not be confirmed", "could not be located", "could not demonstrate", "not re-verified", "not evidenced", "was unclear", "were unclear", "nobody could confirm", "no one could confirm", "could not establish", "not actively enforced", "scope had since changed", "was not timed", "appeared to be in place", "reportedly", "unverified", "tag was unverified", "scaffold tag was unverified", "uncertain", "not clearly confirmed", "unconfirmed", "questionable", "partially completed", "incomplete permit", "hesitated before", "validity uncertain", "expired tag"]

#: Names of barriers.
BARRIER_TERMS = ["isolation", "permit", "ptw", "exclusion zone", "gas test", "gas testing", "gas monitoring", "loto", "lockout", "tagout", "harness", "barricade", "guard", "scaffold tag", "barrier", "sign-off", "lock-out", "tag-out", "lockout-tagout", "isolation certificate", "work permit", "work authorisation", "job safety analysis", "jsa", "gas test certificate", "pre-entry gas check", "atmospheric monitoring", "restricted area cordon", "drop-zone barrier", "cordon", "fall arrest", "anchor point", "edge protection", "fall protection", "machine guard", "coupling guard", "banksman", "journey management plan", "traffic control", "reversing spotter", "interlock", "esd trip", "fire and gas detection", "high-level alarm", "trip system", "lift plan", "rigging inspection", "load chart check", "lifting permit", "red zone", "red-zone", "toolbox talk", "risk assessment", "latched", "pinned and latched", "blind lift", "elevators"]

#: Energy types and their cues.
ENERGY_CUES = {
    "stored/electrical energy": ["electrical", "energised", "energized", "live conductor", "switchgear", "transformer", "busbar", "PMCC", "MCC", "breaker", "stored energy", "capacitor", "440V", "11kV", "415V"],
    "pressure/hydraulic energy": ["pressure", "pressurised", "pressurized", "hydraulic", "pneumatic", "trapped pressure", "blowdown", "depressurise", "depressurize", "hose whip", "accumulator", "wellhead pressure", "bleed off"],
    "thermal (hot work)": ["hot work", "welding", "grinding", "cutting torch", "spark", "flame", "burner", "molten", "steam", "hot surface", "gouging", "brazing"],
    "flammable/explosive atmosphere": ["gas leak", "hydrocarbon release", "flammable vapour", "flammable vapor", "LEL", "explosive atmosphere", "gas cloud", "condensate spill", "methane", "ignition source"],
    "gravitational (suspended load)": ["suspended load", "crane", "hoist", "sling", "rigging", "lifting", "tagline", "boom", "shackle", "load chart", "hydra crane", "tandem lift"],
    "fall from height": ["height", "scaffold", "scaffolding", "fall arrest", "harness", "edge protection", "elevated platform", "derrick", "monkey board", "ladder", "mast", "fragile roof"],
    "kinetic (line of fire)": ["line of fire", "stored tension", "whip", "recoil", "pig launcher", "pig receiver", "snap back", "tensioned", "dropped object", "falling object", "ejected"],
    "mechanical/rotating equipment": ["rotating", "rotating equipment", "pump shaft", "coupling", "guard", "drawworks", "top drive", "belt drive", "flywheel", "gearbox", "entanglement", "nip point"],
    "vehicular/motion": ["vehicle", "reversing", "forklift", "tanker", "trailer", "journey management", "seat belt", "speeding", "banksman", "traffic", "mobile plant"],
    "atmospheric/asphyxiation": ["confined space", "oxygen deficient", "nitrogen purge", "inerting", "tank entry", "vessel entry", "sump", "H2S", "hydrogen sulphide", "hydrogen sulfide", "breathing apparatus", "SCBA", "gas test"],
    "chemical/toxic exposure": ["chemical", "corrosive", "acid", "caustic", "amine", "biocide", "methanol", "splash", "MSDS", "SDS", "toxic", "mud additive"],
    "radiation (NORM/radiography)": ["radiography", "radioactive", "NORM", "gamma", "iridium", "source pit", "radiation barrier", "dose rate", "RSO"],
    "defeated safety system": ["bypass", "bypassed", "overridden", "override", "inhibit", "inhibited", "jumpered", "defeated", "interlock", "ESD", "F&G", "alarm disabled", "trip disabled", "car sealed"],
    "low-energy/ergonomic": ["housekeeping", "manual handling", "ergonomic", "slip", "trip", "spillage", "lighting", "signage", "tidy"],
}

#: Cues met in narratives.
MORE_ENERGY_CUES = {
    "stored/electrical energy": ["live circuit", "live wire", "switchboard", "isolation failure", "high voltage", "arc flash", "power line"],
    "thermal (hot work)": ["open flame", "torch", "spark ignition"],
    "gravitational (suspended load)": ["crane lift", "overhead lift", "hoist line", "derrick lift", "winch cable"],
    "kinetic (line of fire)": ["high pressure line", "kickback", "whip check", "pressurized hose", "pinch point", "flying debris"],
    "mechanical/rotating equipment": ["pinch point", "unguarded shaft", "caught between"],
    "atmospheric/asphyxiation": ["toxic gas", "asphyxiation", "inert atmosphere", "vessel purge"],
    "vehicular/motion": ["heavy vehicle", "truck reversing", "vehicle rollover", "transport collision"],
    "fall from height": ["working at height", "ladder fall", "roof edge", "manlift"],
    "pressure/hydraulic energy": ["stored pressure", "line not depressurised", "pressure test"],
    "flammable/explosive atmosphere": ["gas cloud", "vapour cloud", "hydrocarbon leak"],
    "defeated safety system": ["safety system disabled", "protection defeated", "alarm suppressed"],
    "chemical/toxic exposure": ["chemical burn", "chemical splash"],
    "radiation (NORM/radiography)": ["radiation source", "exposed source"],
}

#: Energy types: rule, magnitude, high energy.
ENERGY_RULES = {
    "stored/electrical energy": ["Energy Isolation", "4", "true"],
    "pressure/hydraulic energy": ["Energy Isolation", "4", "true"],
    "thermal (hot work)": ["Hot Work", "4", "true"],
    "flammable/explosive atmosphere": ["Hot Work", "5", "true"],
    "gravitational (suspended load)": ["Safe Mechanical Lifting", "4", "true"],
    "fall from height": ["Working at Height", "4", "true"],
    "kinetic (line of fire)": ["Line of Fire", "4", "true"],
    "mechanical/rotating equipment": ["Line of Fire", "4", "true"],
    "vehicular/motion": ["Driving", "4", "true"],
    "atmospheric/asphyxiation": ["Confined Space", "5", "true"],
    "chemical/toxic exposure": ["Work Authorisation", "3", "true"],
    "radiation (NORM/radiography)": ["Work Authorisation", "3", "true"],
    "defeated safety system": ["Bypassing Safety Controls", "5", "true"],
    "low-energy/ergonomic": ["Work Authorisation", "1", "false"],
}

#: Energy type that a hazard category stands for.
HAZARD_ENERGY = {
    "energy_isolation": ["stored/electrical energy"],
    "hot_work": ["thermal (hot work)"],
    "confined_space": ["atmospheric/asphyxiation"],
    "line_of_fire": ["kinetic (line of fire)"],
    "safe_mechanical_lifting": ["gravitational (suspended load)"],
    "working_at_height": ["fall from height"],
    "driving": ["vehicular/motion"],
    "excavation": ["stored/electrical energy"],
    "bypassing_safety_controls": ["defeated safety system"],
    "pressure": ["pressure/hydraulic energy"],
    "chemical": ["chemical/toxic exposure"],
    "radiation": ["radiation (NORM/radiography)"],
}

#: Energy types that agree with a hazard category.
HAZARD_ENERGIES = {
    "energy_isolation": ["stored/electrical energy"],
    "hot_work": ["stored/electrical energy", "thermal (hot work)"],
    "confined_space": ["atmospheric/asphyxiation"],
    "line_of_fire": ["gravitational (suspended load)", "kinetic (line of fire)"],
    "safe_mechanical_lifting": ["gravitational (suspended load)", "kinetic (line of fire)"],
    "working_at_height": ["fall from height", "gravitational (suspended load)"],
    "driving": ["vehicular/motion"],
    "excavation": ["kinetic (line of fire)", "stored/electrical energy"],
}

#: Barrier types: direct control, energy types controlled; the first declared one controls an energy type.
BARRIERS = {
    "Energy isolation & LOTO": ["true", "stored/electrical energy", "pressure/hydraulic energy"],
    "Permit to work": ["false", "thermal (hot work)", "chemical/toxic exposure", "radiation (NORM/radiography)", "low-energy/ergonomic"],
    "Gas testing & atmospheric monitoring": ["true", "atmospheric/asphyxiation", "flammable/explosive atmosphere"],
    "Exclusion zone & barricading": ["true", "gravitational (suspended load)", "kinetic (line of fire)", "radiation (NORM/radiography)"],
    "Fall protection": ["true", "fall from height"],
    "Machine guarding": ["true", "mechanical/rotating equipment"],
    "Traffic & journey management": ["false", "vehicular/motion"],
    "Safety instrumented system": ["true", "defeated safety system"],
    "Lifting plan & rigging control": ["false", "gravitational (suspended load)"],
}

#: Abbreviations.
ABBREVIATIONS = {
    "LOTO": ["lockout tagout isolation"],
    "PTW": ["permit to work"],
    "HSSE": ["health safety security environment"],
    "UA/UC": ["unsafe act unsafe condition"],
    "UA": ["unsafe act"],
    "UC": ["unsafe condition"],
    "SIMOPS": ["simultaneous operations"],
    "PMCC": ["power motor control center"],
    "PPE": ["personal protective equipment"],
    "JSA": ["job safety analysis"],
    "HAZOP": ["hazard and operability study"],
    "HAZID": ["hazard identification"],
    "MSDS": ["material safety data sheet"],
    "SCBA": ["self contained breathing apparatus"],
    "PSV": ["pressure safety valve"],
    "ESD": ["emergency shutdown"],
    "MOC": ["management of change"],
    "SOP": ["standard operating procedure"],
    "TBT": ["toolbox talk"],
    "NCR": ["non conformance report"],
    "CAPA": ["corrective and preventive action"],
    "OIM": ["offshore installation manager"],
    "RA": ["risk assessment"],
    "H2S": ["hydrogen sulphide gas"],
    "LEL": ["lower explosive limit"],
    "EX": ["explosion proof"],
    "EWP": ["elevated work platform"],
    "MEWP": ["mobile elevated work platform"],
    "IOGP": ["international association of oil and gas producers"],
    "LSR": ["life saving rule"],
    "SWA": ["stop work authority"],
    "PM": ["preventive maintenance"],
    "OIL": ["oil india limited"],
}

#: Code-mixed phrases.
GLOSSARY = {
    "mazdoor": ["worker"],
    "mazdoor ko": ["the worker"],
    "kaam": ["work"],
    "kaam kar raha tha": ["was working"],
    "khatra": ["hazard"],
    "khatarnak": ["dangerous"],
    "turant": ["immediately"],
    "dekha": ["noticed"],
    "dekha gaya": ["was observed"],
    "bina": ["without"],
    "bina isolation ke": ["without isolation"],
    "jaldi": ["quickly"],
    "sahi": ["correct"],
    "galat": ["incorrect"],
    "supervisor ne bola": ["supervisor instructed"],
    "check nahi kiya": ["was not checked"],
    "permit nahi tha": ["no permit was in place"],
    "area khali tha": ["area was clear"],
    "area khali nahi tha": ["area was not clear"],
    "hataya gaya": ["was removed"],
    "hataya": ["removed"],
}

#: Known misspellings.
TYPOS = {
    "isolaton": ["isolation"],
    "isolaion": ["isolation"],
    "electical": ["electrical"],
    "electricl": ["electrical"],
    "maintainance": ["maintenance"],
    "maintenence": ["maintenance"],
    "safty": ["safety"],
    "saftey": ["safety"],
    "hazerdous": ["hazardous"],
    "hazardus": ["hazardous"],
    "confimed": ["confirmed"],
    "confrimed": ["confirmed"],
    "excavtion": ["excavation"],
    "excavaton": ["excavation"],
    "supervsor": ["supervisor"],
    "supervizor": ["supervisor"],
    "permitt": ["permit"],
    "wielding": ["welding"],
    "weldng": ["welding"],
    "verfied": ["verified"],
    "verifed": ["verified"],
    "exlusion": ["exclusion"],
    "exclustion": ["exclusion"],
    "sispended": ["suspended"],
    "suspeded": ["suspended"],
}
