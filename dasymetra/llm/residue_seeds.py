"""Seed texts of the residue models, from public knowledge: standard filler, HTTP reason phrases, default pages of servers and browsers, run-time errors.

None is taken from the documents to be judged; what those hold beyond the seeds is learned from them.
"""

#: Filler that stands in for text to come.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti
Curabitur pretium tincidunt lacus, nulla gravida orci a odio, nullam varius, turpis et commodo pharetra
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet, ante, donec eu libero sit amet quam egestas semper
Aenean ultricies mi vitae est, mauris placerat eleifend leo, quisque sit amet est et sapien ullamcorper pharetra
Integer in mauris eu nibh euismod gravida, duis ac tellus et risus vulputate vehicula, sodales ligula in libero
Praesent dapibus, neque id cursus faucibus, tortor neque egestas augue, eu vulputate magna eros eu erat
Maecenas sed diam eget risus varius blandit sit amet non magna, cras mattis consectetur purus sit amet fermentum
Replace this text with your own content
Insert your text here
Add your text here
Enter your text here
Type your text here
Click here to add a title
Click to edit this paragraph
Edit this headline
Add a subheading here
Your title goes here
Describe your product here
A short summary goes here
This is a sample paragraph
This is placeholder text
Sample sentence for testing
Dummy text, please ignore
Example content, to be replaced before publishing
To be replaced with final copy
TODO: add content
TODO: write this section
FIXME: missing translation
Translation pending
Content coming soon
testing one two three
foo bar baz qux
asdf asdf asdf qwerty
The quick brown fox jumps over the lazy dog
Substitua este texto pelo seu conteúdo
Insira seu texto aqui
Digite seu texto aqui
Clique para adicionar um título
Adicione um subtítulo aqui
Seu texto aqui
Descreva o seu produto aqui
Uma breve descrição vai aqui
Este é um parágrafo de exemplo
Texto provisório, a substituir antes da publicação
Frase de exemplo para teste
TODO: escrever esta seção
Tradução pendente, traduzir depois
Conteúdo em breve
Um dois três testando
Reemplace este texto con su propio contenido
Inserte su texto aquí
Escriba su texto aquí
Haga clic para agregar un título
Añada un subtítulo aquí
Su texto aquí
Describa su producto aquí
Una breve descripción va aquí
Este es un párrafo de ejemplo
Texto provisional que se sustituirá antes de la publicación
Frase de ejemplo para la prueba
TODO: escribir esta sección
Traducción pendiente, falta traducir
Contenido próximamente
Probando uno dos tres
Remplacez ce texte par votre contenu
Insérez votre texte ici
Saisissez votre texte ici
Cliquez pour ajouter un titre
Ajoutez un sous-titre ici
Votre texte ici
Décrivez votre produit ici
Une brève description ici
Ceci est un paragraphe d'exemple
Texte provisoire, à remplacer avant publication
Phrase d'exemple pour un essai
TODO : rédiger cette section
Traduction à faire, segment à traduire
Contenu à venir
Un deux trois essai
Ersetzen Sie diesen Text durch Ihren eigenen
Fügen Sie hier Ihren Text ein
Text hier eingeben
Klicken Sie, um einen Titel hinzuzufügen
Unterüberschrift hier einfügen
Hier steht Ihr Text
Hier könnte Ihre Beschreibung stehen
Dies ist ein Blindtext
Ich bin Blindtext, von Geburt an
Platzhaltertext, vor der Veröffentlichung zu ersetzen
Beispielsatz zum Testen
TODO: Abschnitt schreiben
Übersetzung fehlt noch, bitte übersetzen
Inhalt folgt in Kürze
Eins zwei drei Test
Franz jagt im komplett verwahrlosten Taxi quer durch Bayern
このテキストを差し替えてください
ここにテキストを入力してください
ここにタイトルを入力します
ここに説明文を入れてください
見出しを追加してください
これはサンプルの文章です
これはダミーの文章です、後で差し替えます
仮のテキスト、公開前に変更してください
テスト用の文章です
この節を翻訳してください、未翻訳です
近日公開予定の内容です
""".strip().splitlines()

#: Messages of failing or refusing servers and programs, and notices that a browser or scripts are needed.
NOTICE = """
400 Bad Request
401 Unauthorized
403 Forbidden
404 Page Not Found
405 Method Not Allowed
408 Request Timeout
410 Gone
413 Payload Too Large
429 Too Many Requests
500 Internal Server Error
HTTP 501 Not Implemented
502 Bad Gateway
HTTP error 503: the service is unavailable
504 Gateway Timeout
Error 403: you do not have access to this page
Error 404: the requested page was not found
Error 500: internal error
The requested URL was not found on this server
You don't have permission to access this resource
The server encountered an internal error or misconfiguration and was unable to complete your request
Please contact the server administrator
The server is temporarily unable to service your request due to maintenance downtime or capacity problems
The page you are looking for might have been removed, had its name changed, or is temporarily unavailable
The page cannot be found
Oops! That page can't be found
Sorry, this page does not exist any more
It looks like nothing was found at this location
The link may be broken or the page may have been moved
Return to the home page
Go back to the previous page
This site can't be reached
The server took too long to respond
The connection has timed out
Unable to connect to the server
Hmm, we're having trouble finding that site
Something went wrong, please try again later
An unexpected error occurred
We are sorry, an error has occurred while processing your request
Try again in a few minutes or contact support
Service temporarily unavailable
The service is currently unavailable
Access to this page has been denied
Sorry, you have been blocked
You have sent too many requests, please slow down
Our systems have detected unusual traffic from your network
Your session has ended, please log in again
Session expired
There has been a critical error on this website
Could not connect to the database
Database error: connection refused
Incident number 0, reference number 0
Request id h
Error code h
Please enable JavaScript and cookies to continue
You need to enable JavaScript to run this app
JavaScript is disabled in this browser
JavaScript is not available, please switch to a supported browser
This site requires JavaScript to work properly
This application requires scripts
Scripts have been blocked by your browser settings
Allow scripts and reload the page
Cookies are disabled, enable them to view this page
Your browser is out of date
Your browser does not support this feature
This browser is not supported, please upgrade your browser
Checking if the site connection is secure
Checking your browser before accessing the site
Please wait while we verify your browser
Verify that you are human
Confirm you are not a robot by pressing the button
Complete the captcha to show the content
Traceback (most recent call last): File "app.py", line 0, in main ValueError: invalid literal
File "/usr/lib/python0/site.py", line 0, in <module> TypeError: unsupported operand
Exception in thread "main" java.lang.IllegalStateException at com.example.Main.run(Main.java:0)
java.lang.RuntimeException at org.example.Service.handle(Service.java:0)
Caused by: java.io.IOException: broken pipe at java.base/java.lang.Thread.run(Thread.java:0)
Fatal error: Uncaught Error: Call to a member function on null in /var/www/html/index.php:0
PHP Warning: Undefined variable in /var/www/html/page.php on line 0
Notice: Undefined index: id in /home/site/public_html/list.php on line 0
Parse error: syntax error, unexpected end of file in /var/www/html/config.php on line 0
Warning: mysqli_connect(): Access denied for user in /var/www/db.inc:0
Uncaught TypeError: Cannot read properties of undefined at Object.render (main.js:0:0)
UnhandledPromiseRejectionWarning: Error: connect ECONNREFUSED
panic: runtime error: index out of range [0] with length 0 goroutine 0 [running]: main.main() exit status 0
thread 'main' panicked at src/main.rs:0:0
Segmentation fault, process finished with exit code 0
core dumped: signal 0
Object reference not set to an instance of an object at Program.Main in Program.cs:line 0
Unhandled exception: out of memory
Requisição inválida (400)
Não autorizado (401)
Acesso proibido (403)
Erro 404: a página não foi encontrada
Erro 500: erro interno no servidor
A página que você procura não existe ou foi removida
Não encontramos a página solicitada
O endereço pode estar errado ou a página foi movida
Voltar para a página inicial
Não é possível acessar esse site
O servidor demorou muito para responder
O servidor encontrou um erro interno
Ocorreu um erro inesperado
Algo deu errado, tente novamente mais tarde
Tente novamente em alguns instantes
Serviço temporariamente indisponível
O serviço está indisponível
Você não tem permissão para acessar este recurso
Acesso bloqueado
Excesso de solicitações, aguarde
Sua sessão foi encerrada, entre novamente
Sessão expirada
Não foi possível conectar ao banco de dados
Entre em contato com o administrador do sistema
Código do erro h
Habilite o JavaScript no navegador para continuar
Você precisa ativar o JavaScript para usar este site
O JavaScript está desabilitado neste navegador
Este site requer JavaScript
Permita os scripts e recarregue a página
Scripts bloqueados pelo navegador
Os cookies estão desativados, ative-os para ver esta página
Seu navegador está desatualizado
Este navegador não é suportado
Estamos verificando o navegador, aguarde
Confirme que você não é um robô
Clique no botão para mostrar o conteúdo
Solicitud incorrecta (400)
No autorizado (401)
Acceso prohibido (403)
Error 404: no se encontró la página
Error 500: error interno en el servidor
La página que busca no existe o ha sido eliminada
No encontramos la página solicitada
La dirección puede ser incorrecta o la página se ha movido
Volver a la página de inicio
No se puede acceder a este sitio web
El servidor ha tardado demasiado en responder
El servidor encontró un error interno
Se ha producido un error inesperado
Algo ha salido mal, inténtelo más tarde
Vuelva a intentarlo en unos instantes
Servicio temporalmente no disponible
El servicio no está disponible
No tiene permiso para acceder a este recurso
Acceso bloqueado
Exceso de solicitudes, espere
Su sesión ha terminado, vuelva a entrar
Sesión caducada
No se pudo conectar con la base de datos
Póngase en contacto con el administrador del sistema
Código de error h
Habilite JavaScript en el navegador para continuar
Necesita activar JavaScript para usar este sitio
JavaScript está deshabilitado en este navegador
Este sitio requiere JavaScript
Permita los scripts y recargue la página
Scripts bloqueados por el navegador
Las cookies están desactivadas, actívelas para ver esta página
Su navegador está desactualizado
Este navegador no es compatible
Estamos comprobando el navegador, espere
Confirme que no es un robot
Pulse el botón para mostrar el contenido
Requête incorrecte (400)
Non autorisé (401)
Accès interdit (403)
Erreur 404 : la page est introuvable
Erreur 500 : erreur interne du serveur web
La page que vous cherchez n'existe pas ou a été supprimée
Nous n'avons pas trouvé la page demandée
L'adresse est peut-être erronée ou la page a été déplacée
Retour à la page d'accueil
Ce site est inaccessible
Le serveur a mis trop de temps à répondre
Le serveur a rencontré une erreur interne
Une erreur inattendue s'est produite
Un problème est survenu, réessayez plus tard
Veuillez réessayer dans quelques instants
Service temporairement indisponible
Le service n'est pas disponible
Vous n'avez pas le droit d'accéder à cette ressource
Accès bloqué
Trop de demandes, veuillez patienter
Votre session est terminée, reconnectez-vous
Session expirée
Impossible de se connecter à la base de données
Veuillez contacter l'administrateur du système
Code d'erreur h
Activez JavaScript dans le navigateur pour continuer
Vous devez activer JavaScript pour utiliser ce site
JavaScript est désactivé dans ce navigateur
Ce site nécessite JavaScript
Autorisez les scripts et rechargez la page
Scripts bloqués par le navigateur
Les cookies sont désactivés, activez-les pour afficher cette page
Votre navigateur est obsolète
Ce navigateur n'est pas compatible
Nous vérifions le navigateur, veuillez patienter
Confirmez que vous n'êtes pas un robot
Cliquez sur le bouton pour afficher le contenu
Ungültige Anfrage (400)
Nicht autorisiert (401)
Zugriff verboten (403)
Fehler 404: die Seite wurde nicht gefunden
Fehler 500: interner Fehler des Servers
Die gesuchte Seite existiert nicht oder wurde entfernt
Die angeforderte Seite konnte nicht gefunden werden
Die Adresse ist falsch oder die Seite wurde verschoben
Zur Startseite zurückkehren
Die Website ist nicht erreichbar
Die Antwort vom Server hat zu lange gedauert
Auf dem Server ist ein interner Fehler aufgetreten
Ein unerwarteter Fehler ist aufgetreten
Etwas ist schiefgelaufen, versuchen Sie es später erneut
Bitte versuchen Sie es in Kürze erneut
Der Dienst ist vorübergehend nicht verfügbar
Sie haben keine Berechtigung, auf diese Ressource zuzugreifen
Zugriff gesperrt
Zu viele Anfragen, bitte warten
Ihre Sitzung wurde beendet, bitte melden Sie sich erneut an
Sitzung abgelaufen
Keine Verbindung zur Datenbank
Bitte den Administrator des Systems verständigen
Fehlercode h
Bitte aktivieren Sie JavaScript im Browser, um fortzufahren
Sie müssen JavaScript aktivieren, um diese Seite zu benutzen
JavaScript ist in diesem Browser deaktiviert
Diese Website erfordert JavaScript
Erlauben Sie Skripte und laden Sie die Seite neu
Skripte vom Browser blockiert
Cookies sind abgeschaltet, schalten Sie sie ein, um die Seite zu sehen
Ihr Browser ist veraltet
Dieser Browser wird nicht mehr unterstützt
Wir überprüfen den Browser, bitte warten
Bestätigen Sie, dass Sie kein Roboter sind
Klicken Sie auf die Schaltfläche, um den Inhalt anzuzeigen
不正なリクエストです（400）
認証が必要です（401）
アクセスは禁止されています（403）
404エラー：指定されたページは見つかりませんでした
500エラー：サーバー内部でエラーが発生しました
ページが存在しません
お探しのページは削除されたか移動しました
指定されたアドレスは変更されたか間違っています
ホームページに戻る
このサイトにアクセスできません
サーバーからの応答が遅すぎます
サーバーに接続できませんでした
予期しないエラーが発生しました
エラーが発生しました、しばらくしてからもう一度お試しください
サービスは一時的にご利用いただけません
このページにアクセスする権限がありません
アクセスがブロックされました
リクエストが多すぎるため、しばらくお待ちください
セッションが切れました、再度ログインしてください
データベースへの接続に失敗しました
システム管理者にお問い合わせください
エラーコード：h
続けるにはブラウザでJavaScriptを有効にしてください
このサイトを使うにはJavaScriptが必要です
このブラウザではJavaScriptが無効です
スクリプトを許可してページを再読み込みしてください
スクリプトがブラウザにブロックされました
Cookieが無効です、有効にしてこのページを表示してください
ブラウザのバージョンが古くなっています
このブラウザはサポートされていません
ブラウザを検証しています、お待ちください
ロボットではないことを確認してください
ボタンを押すとコンテンツが表示されます
""".strip().splitlines()

#: Marks that open and close the name of a field in a template.
BRACKETS = (
    ("{{", "}}"), ("{{ ", " }}"), ("{{{", "}}}"), ("{", "}"), ("${", "}"), ("#{", "}"), ("<%= ", " %>"), ("{% ", " %}"), ("<", ">"), ("<<", ">>"),
    ("[", "]"), ("[[", "]]"), ("((", "))"), ("%(", ")s"), ("%", "%"), ("$", "$"), ("~", "~"), ("__", "__"), ("@@", "@@"), ("&&", "&&"),
)
#: Marks that stand for a value on their own.
ALONE = ("%s", "%d", "%1$s", "$1", "{}", "{{}}", "{0}", "{0:name}", "____", "???", "XX/XX/XXXX", "#REF!", "#N/A", "#VALUE!", "#NAME?", "undefined", "NaN", "TBD", "N/A", "[object Object]", "(null)", "null")
#: Words that make a mark of their own where they stand alone.
MARKER_WORDS = ("undefined", "nan", "tbd", "null", "insert", "inserir", "insertar", "upper", "lower", "xx", "xxxx", "sic", "todo")
