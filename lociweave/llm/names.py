"""Given names by gender and script, family names by script, and titles. Short public lists; surrogates are drawn from them."""

GIVEN = {
    ("f", "latin"): "Mary Anna Emma Laura Julia Sophie Maria Clara Alice Sarah Emily Lisa Claudia Petra Monika Sabine Camille Chloe Manon Juliette Amelie Elise Carmen Lucia Elena Isabel Paula Rosa Pilar Teresa Linda Susan Karen Nancy Helen Ruth Grace Jane Diana Olivia Hannah Charlotte Greta Heidi Ingrid Nora Eva Irene Marta Silvia Jennifer Patricia Elizabeth Barbara Jessica Margaret Sandra Ashley Donna Michelle Priya Anjali Lakshmi Fatima Aisha Leila Yuki Sakura Mei Xiu Ngozi Amina Katarzyna Agnieszka Ana Beatriz Giulia Francesca Xenia Zoe Rebecca Rachel Deborah Samantha".split(),
    ("m", "latin"): "John James Robert Michael David Thomas Peter Paul Martin Daniel Mark Andrew Stefan Klaus Hans Juergen Wolfgang Dieter Pierre Jean Luc Antoine Henri Louis Julien Carlos Juan Pedro Miguel Luis Jorge Diego Pablo Fernando George Edward Henry Charles Frank Walter Simon Oliver Felix Lukas Jonas Emil Anton Bruno Hugo Marco William Richard Joseph Christopher Matthew Anthony Steven Kevin Brian Kenneth Rahul Amit Arjun Vijay Mohammed Ahmed Omar Hassan Ali Hiroshi Kenji Wei Jian Chidi Kwame Piotr Tomasz Luca Giovanni Alessandro Xavier Benjamin Samuel Jonathan Timothy Jacob Nicholas".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Юлия Екатерина Дарья Вера".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел Владимир Олег Борис Юрий".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Δήμητρα Ειρήνη Χριστίνα".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Γιάννης Κώστας Παύλος Ανδρέας Πέτρος".split(),
}
FAMILY = {
    "latin": "Smith Johnson Brown Taylor Miller Wilson Moore Clark Lewis Walker Hall Young King Wright Scott Green Baker Adams Nelson Carter Mueller Schmidt Fischer Weber Becker Hoffmann Schulz Koch Richter Wolf Dubois Moreau Laurent Lefebvre Michel Garnier Fournier Girard Rousseau Fontaine Fernandez Lopez Gomez Perez Sanchez Romero Torres Navarro Molina Ortega Sharma Patel Gupta Singh Khan Hussain Haddad Tanaka Suzuki Chen Wang Okafor Mensah Kowalski Nowak Silva Costa Rossi Bianchi Ferrari Kennedy Murphy Jensen Nielsen Larsen Lindberg".split(),
    "cyrillic": "Иванов Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов Волков".split(),
    "greek": "Παπαδόπουλος Νικολάου Γεωργίου Δημητρίου Ιωάννου Βασιλείου".split(),
}
TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Sr Don Sir".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mademoiselle Mlle Señora Señorita Sra Srta Doña Madam Lady".split(),
    "": "Dr Prof Professor".split(),
}
