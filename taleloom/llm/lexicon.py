"""Words by which messages, notices and fillers are told from texts about them, in several languages.

Each kind of message has core concepts, of which all must occur, and words that go with them. No sentence is spelled out: a
segment is a message if its words are nearly all of the kind.
"""

from __future__ import annotations

from dataclasses import dataclass


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Words that carry no topic, beside the function words of the table.
PLAIN = _set(
    """a an the this that these those is are was were be been being has have had do does did will would shall should may might must can and or but so as at if
    by for from in into of off on out over to up with without it its your you our us me my we i're not no any all some one there here then than too very just
    please sorry bitte por favor veuillez pardon désolé désolée s'il vous plaît prego

    der die das den dem des ein eine einen einem einer und oder aber ist sind war wird werden wurde wurden hat haben nicht kein keine zu zum zur im am auf
    aus für von mit es sie ihr ihre ihren ihrem wir diese dieser dieses diesen um hier noch wieder sein muss müssen kann können

    le la les l un une des du de et ou mais est sont été a ont ne pas sur dans pour par avec cette ce cet ces votre vos il elle nous vous en à au aux que qui

    el los las uno una unos y o pero es son fue ha han se su sus tu tus en por para con esta este esto no lo al del que

    lo gli i e ed è sono della del dello nel nella questo questa per il si non di da tuo tua suo sua um uma os as não seu sua este esta foi e ou
    het een dit deze uw niet wordt zijn"""
)

#: Words that show that somebody tells of a thing; one of them makes a segment a text.
TELLING = _set(
    """said says say saying told tells tell asked asks replied whispered wrote writes written explained explains describes described mentioned mentions noted
    notes remembered learned thought thinks knew knows believed called calls named counted counts we'd he he's she she's they they'd i i'm i'd him her his hers
    their them himself herself whenever once ago yesterday because although sagte sagt erzählte schrieb er ihn ihm weil dit disait raconte raconta écrit elle
    dijo dice contó escribió él ella ellos porque ha detto scrisse logged logging treat treats treated
    sentence paragraph's word words section's chapter poem novel essay"""
)

#: What one who speaks of oneself says in a message.
OWN_FAILURE = _set("could couldn't can't cannot unable are experiencing apologize apologise encountered find sorry")

_THINGS = """page pages webpage homepage site website web url urls link links address server servers host gateway proxy resource file files document session sessions
    connection network database request requests service api browser application app login account content access permission http https code status
    seite seiten webseite internetseite website adresse server dienst verbindung sitzung anfrage datei datenbank zugriff zugang browser anwendung dokument
    page site adresse serveur service connexion session requête demande fichier accès ressource navigateur document
    página páginas sitio web enlace dirección servidor servicio conexión sesión solicitud archivo acceso recurso navegador documento
    pagina sito indirizzo servizio connessione sessione richiesta risorsa ligação conexão sessão pedido recurso verzoek verbinding sessie bestand toegang"""
#: Words that tell of a failure only beside a negation; with one they count as ``not-`` and the word.
NEGATIONS = _set("not no cannot can't couldn't doesn't isn't don't longer unable too never nicht kein keine pas plus aucune no ningún ninguna non não niet geen")
NEGATED = _set(
    """found find exist exists available loaded opened displayed shown reached authorized permission permitted allowed limit many respond
    gefunden existiert vorhanden verfügbar erreichbar berechtigt geladen trouvée trouvé existe disponible encontrada encontrado trovata trovato esiste autorisé autorizado gevonden bestaat"""
)
_NOT = " ".join(sorted("not-" + w for w in NEGATED))
_FAILURES = f"""{_NOT} error errors err failed fails failure fail failing missing forbidden denied unauthorized unauthorised unauthenticated unavailable unreachable offline down
    maintenance timeout time-out timed expired invalid refused reset rejected aborted interrupted overloaded exceeded gone moved deleted removed broken wrong
    unable cannot can't couldn't unexpected unknown bad internal gateway oops whoops uh-oh
    fehler fehlgeschlagen verboten verweigert abgelaufen ungültig unterbrochen abgebrochen überlastet leider wartung wartungsarbeiten
    erreur échec échoué introuvable interdit interdite refusé refusée expiré expirée indisponible invalide interrompue inaccessible inattendue maintenance impossible
    error fallo falló prohibido denegado denegada caducado caducada expirado expirada inválida mantenimiento interrumpida
    errore vietato negato scaduta scaduto disponibile erro negado expirou indisponível fout geweigerd verlopen"""
_FAILURE_COMPANY = """requested permanently temporarily currently again later soon back try trying reload refresh retry return go home start contact support administrator admin webmaster
    something went happened occurred while load loading processing opening find looking look view see open log sign in reach reached establishing establish process processed handle serve
    method not allowed too many entity content large length required precondition unprocessable locked conflict acceptable time out id ref reference trace incident ray ms seconds
    minutes check spelling typed correct incorrect sent received response empty timeout oops technical difficulties problem problems issue issues encountered experiencing inconvenience apologize
    apologise experience team been notified could now longer null exception stack version supported variant redirect redirects loop payment upgrade nginx apache cloudflare tomcat early failed dependency storage
    insufficient network authentication site ran end we're we've well known more closed because security reasons
    angeforderte angeforderten später erneut versuchen versuchen laden neu startseite zurück aufgetreten unerwarteter zeitüberschreitung seitenfehler interner vorübergehend melden anmelden ungültige
    demandée demandé recherchez cherchez réessayez réessayer plus tard retour accueil produite survenue oups délai dépassé interne temporairement revenez reconnectez-vous reconnecter rechargez
    sentimos lamentamos solicitada solicitado buscas busca inténtelo inténtalo nuevo tarde vuelve vuelva inicio volver producido ocurrido ups vaya interno temporalmente recargue recarga iniciar sesión
    richiesta richiesto riprova più tardi torna solicitada tente novamente mais tarde opgevraagde probeer opnieuw"""

#: What has become of a thing that is not there; two of these words make a message.
_LOST = "moved deleted removed expired renamed archived relocated verschoben gelöscht entfernt déplacée déplacé supprimée supprimé movida movido eliminada eliminado borrada spostata rimossa eliminata"

_SCRIPTS = "javascript js script scripts scripting noscript skripte skript"
_NEEDS = """enable enabled enabling activate activated activating turn turned switch switched allow allowed permit unblock required requires require need needs needed necessary disabled off deactivated blocked
    run runs support supports supported execute
    aktivieren aktiviert aktiviere schalten schalte einschalten eingeschaltet zulassen erlauben benötigt erfordert erforderlich deaktiviert ausgeschaltet unterstützt braucht
    activer activé activez autoriser autorisez nécessite nécessaire requis requiert désactivé désactivés désactivée bloqué supporte
    activa activar active activado habilita habilitar habilite habilitado permite permitir requiere necesita necesario desactivado deshabilitado bloqueado
    abilita abilitare attiva attivare attivato richiede necessario disabilitato disattivato ative ativar habilite desativado requer inschakelen ingeschakeld vereist nodig schakel uitgeschakeld"""
_NEED_COMPANY = """browser browser's page site website web app application reader document content settings continue proceed read rest view see load use using work works working properly correctly fully function
    functional functionality story features interactive experience must currently appears seems looks like shown displayed display show shown cannot without first reload refresh nothing happens now your
    then try again order it because modern version ihrem ihren fortzufahren fortfahren anzuzeigen anzeigen nutzen verwenden zu können sehen lesen seite browser einstellungen inhalt damit funktioniert richtig vollständig
    continuer lire afficher voir utiliser navigateur page site contenu paramètres fonctionner fonctionne correctement cette
    seguir continuar leer ver usar utilizar navegador página sitio contenido correctamente funcionar funciona configuración
    continuare proseguire visualizzare vedere leggere tuo pagina sito funziona navegador página continuar visualizar verder gaan om te doorgaan bekijken gebruiken"""

_FILLERS = """lorem ipsum dummy placeholder filler sample blindtext platzhalter platzhaltertext fülltext beispieltext mustertext factice provisoire remplissage exemple relleno ejemplo provisional segnaposto
    provvisorio esempio prova marcador opvultekst voorbeeldtekst boilerplate"""
_PROMPTS = """insert add type enter put write place replace paste edit fill goes go schreiben einfügen eintragen eingeben ersetzen steht stehen kommt insérer insérez saisir saisissez écrivez ajoutez remplacer
    insertar inserte inserta escriba escribe añade añadir agregue reemplazar sustituir cambiar inserisci scrivi aggiungi sostituire inserir escreva adicione substituir invoegen typ vervang tbd todo"""
_TEXTS = """text texts copy content contents paragraph description summary headline heading title subtitle caption body bio biography quote sentence intro introduction story tale article
    message comment section image photo name something anything words
    platzhaltertext blindtext beispieltext mustertext text inhalt beschreibung überschrift absatz titel hier etwas texte contenu description titre paragraphe légende ici quelque chose texto contenido descripción título párrafo aquí algo
    testo contenuto descrizione titolo qui paragrafo conteúdo descrição aqui tekst inhoud hier"""
_FILL_COMPANY = """short brief long few before after release publishing publication launch later final real actual own this page post item product company pending change changed swap need needs used only purposes
    demonstration demo testing design layout about your her be to added come coming soon follow missing click double edit tap

    kurze kurzen ihren deinen dein ihr dient nur als noch ändern votre vos court courte à avant publication pendiente tu su breve antes publicar definitivo il tuo breve prima"""


@dataclass(frozen=True)
class Kind:
    """A kind of message: groups of core words of which each must occur (with so many words), and all words that belong to it."""

    name: str
    cores: tuple[frozenset[str], ...]
    company: frozenset[str]
    least: float
    words: int


def _kind(name: str, cores: tuple[str, ...], company: str, least: float, also: tuple[str, ...] = (), words: int = 1) -> Kind:
    every = _set(" ".join((*cores, company, *also)))
    return Kind(name, tuple(map(_set, cores)), every, least, words)


KINDS = (
    _kind("error page", (_THINGS, _FAILURES), _FAILURE_COMPANY, 0.75),
    _kind("error page", (_FAILURES, _FAILURE_COMPANY), _THINGS, 0.8),
    _kind("error page", (_LOST,), f"{_THINGS} {_FAILURES} {_FAILURE_COMPANY}", 0.66, words=2),
    _kind("script notice", (_SCRIPTS, _NEEDS), _NEED_COMPANY, 0.7),
    _kind("filler", (_FILLERS, _TEXTS), _FILL_COMPANY, 0.7, (_PROMPTS,)),
    _kind("filler", (_PROMPTS, _TEXTS), _FILL_COMPANY, 0.75, (_FILLERS,)),
)
#: Words of which a segment must hold one to be looked at.
CUES = frozenset(w.removeprefix("not-") for k in KINDS for w in k.cores[0]) | {"java"}
SCRIPTS = _set(_SCRIPTS)
